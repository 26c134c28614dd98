"""All public names in one place, with the verbs as functions."""

from __future__ import annotations

from loomrec.functions import Link
from loomrec.operators.matrix import col_nnz, factor_gram, gram, row_nnz, row_norms, sampled_product, weighted_degrees
from loomrec.operators.metrics import (
    ap_at_k, mae, mean_ap_at_k, mean_mae, mean_ndcg_at_k, mean_precision_at_k, mean_recall_at_k, mean_rmse, ndcg_at_k,
    precision_at_k, ranking_metrics, recall_at_k, rmse,
)
from loomrec.operators.splits import random_holdout, temporal_split
from loomrec.plans.base import ExplicitModel, ItemSimilarity, MatrixFactorization, Recommender, SoftALS, SparseModel, SparseRegression
from loomrec.plans.callbacks import Callback, CallbackInfo, Checkpoint, EarlyStopping, LearningRate, LossHistory
from loomrec.plans.completion import PureSVD, SoftImpute, SoftSVD
from loomrec.plans.explicit import BaselineOnly, PearsonKNN, SlopeOne
from loomrec.plans.factorization import CachedALS, ElementwiseALS, Feedback, Solver, WeightedMF
from loomrec.plans.itemsim import GraphRandomWalk, ItemKNN, ShallowAutoencoder, SparseLinearADMM, SparseLinearModel
from loomrec.plans.regression import FTRL, FactorizationMachine
from loomrec.plans.search import cross_validate, grid_search, random_search
from loomrec.plans.stochastic import GlobalVectors, LogisticMF, PairwiseRanking, ProbabilisticMF, Sampling
from loomrec.sources.models import load_model, save_model
from loomrec.sources.triplets import Interactions, from_ratings, index_ids, ingest_triplets, to_triplets


def by_user(matrix: Interactions):
    """Entries placed by user, for work on rows of the matrix."""
    return matrix.x.repartition("user_id")


def fit(model, data, *args, **kwargs):
    return model.fit(data, *args, **kwargs)


def update(model, data, *args, **kwargs):
    return model.update(data, *args, **kwargs)


def recommend(model, data, k: int = 10, **kwargs):
    return model.recommend(data, k, **kwargs)


def score(model, data=None):
    return model.score() if data is None else model.score(data)


def predict(model, pairs):
    return model.predict(pairs)


def transform(model, data):
    return model.transform(data)


def coef(model, spark):
    return model.coef(spark)


def embeddings(model):
    return model.embeddings()


def similar_items(model, item: int, k: int = 10):
    return model.similar_items(item, k)


def similar_users(model, user: int, k: int = 10):
    return model.similar_users(user, k)


__all__ = [name for name in dir() if not name.startswith("_") and name != "annotations"]

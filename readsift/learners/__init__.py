"""Classifiers by name."""

from __future__ import annotations

from readsift.learners.base import Fitted, fit
from readsift.learners.exact_tree import ExactTree
from readsift.learners.neighbour_vote import Neighbours
from readsift.learners.online import linear_svm, passive_aggressive, perceptron
from readsift.learners.rectified import RectifiedNetwork
from readsift.learners.simple import Dummy, NaiveBayes
from readsift.learners.spark_ml import Logit, Network, Tree

LEARNERS = {
    "dummy": Dummy,
    "tree": Tree,
    "exact_tree": ExactTree,
    "logit": Logit,
    "bayes": NaiveBayes,
    "neighbours": Neighbours,
    "network": Network,
    "rectified_network": RectifiedNetwork,
    "perceptron": perceptron,
    "passive_aggressive": passive_aggressive,
    "linear_svm": linear_svm,
}


def learner(name: str, **params):
    """Build a learner; an unknown name fails."""
    if name not in LEARNERS:
        raise ValueError(f"unknown learner {name}, known: {', '.join(sorted(LEARNERS))}")
    return LEARNERS[name](**params)


__all__ = ["Fitted", "LEARNERS", "fit", "learner"]

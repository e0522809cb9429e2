"""Registries: named factories for retrievers, providers, engines and evaluators."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            self._made[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._made:
            raise KeyError(f"unknown {self.kind} {name!r}; there are {', '.join(self.names())}")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)


RETRIEVERS, PROVIDERS, ENGINES, EVALUATORS = Registry("retriever"), Registry("provider"), Registry("engine"), Registry("evaluator")


def load_plugins(modules: list[str]) -> None:
    """Import modules that register something of their own."""
    import importlib

    for m in modules:
        importlib.import_module(m)


def runnable_datasets() -> tuple[list[str], dict[str, list[str]]]:
    """Datasets with an evaluator and a prompt builder, and what the others lack."""
    from rankframe.functions.prompts import BUILDERS

    both = set(EVALUATORS.names()) & set(BUILDERS)
    lacking = {d: [w for w, have in (("evaluator", EVALUATORS.names()), ("prompt builder", BUILDERS)) if d not in have] for d in (set(EVALUATORS.names()) | set(BUILDERS)) - both}
    return sorted(both), lacking


def listing() -> dict[str, list[str]]:
    return {r.kind: r.names() for r in (RETRIEVERS, PROVIDERS, ENGINES, EVALUATORS)}


def _fill() -> None:
    from rankframe.operators import answers, dense, fusion, graph, rerank, select, sparse
    from rankframe.plans import engines  # noqa: F401  (registers the engines)

    retrievers = {
        "bm25": sparse.bm25, "tfidf": sparse.tfidf, "dense": dense.dense_topk, "linearrag": graph.linear_rag,
        "hybrid": fusion.round_robin, "rrf": fusion.rrf, "kmeans_rerank": rerank.cluster_blend, "cross_encoder_rerank": rerank.pair_blend, "llm_rerank": rerank.listwise,
    }
    for name, rank in retrievers.items():
        RETRIEVERS.register(name)(rank)
    for name in ("none", "oracle", "topk", "llm_select"):
        PROVIDERS.register(name)(getattr(select, name))
    PROVIDERS.register("oracle_distractor")(select.distractors)
    for name, judge in answers.JUDGES.items():
        EVALUATORS.register(name)(judge)


_fill()

"""Runs: prompts to a pluggable responder, resume, experiment grids, paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankframe.functions.prompts import prompts
from rankframe.functions.text import model_short_name
from rankframe.plans.engines import Outcome, Responder
from rankframe.plans.registry import ENGINES

RECORDS = "instance_id string, dataset string, raw_output string, transcript string, skill_ids_used array<string>, error string"


def pending(instances: DataFrame, done: DataFrame) -> DataFrame:
    """Instances without a record; a record with an error counts as done."""
    return instances.join(done.select("instance_id").distinct(), "instance_id", "left_anti")


def rerank_pending(queries: DataFrame, done: DataFrame, made_for: int | None, k: int) -> DataFrame:
    """Queries to rerank: rows of an earlier run count only if it was made for the same k."""
    return queries if made_for != k else queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def _plain(value: object) -> object:
    """Rows and arrays as dicts and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [_plain(v) for v in value]
    return value


def run_many(
    instances: DataFrame, chosen: DataFrame, skills: DataFrame, responder: Responder, engine: str = "direct", execute: Callable[[str], str] | None = None, functions: dict[str, Callable] | None = None
) -> DataFrame:
    """Records of ``instances(instance_id, dataset, question)`` with the skills of
    ``chosen(instance_id, place, skill_id)`` in their prompts. An instance that fails gives a
    record with its error; the others go on.

    ``execute(action)`` runs the actions of ReAct engines. Tools of skills (``tools``, where
    the table has them) are called by name through ``functions``; code that a skill brings
    along is never run.
    """
    fields = ["skill_id", "name", "description", "content"] + (["tools"] if "tools" in skills.columns else [])
    used = chosen.join(skills.select(*fields), "skill_id")
    used = used.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("place", *fields))).alias("skills"))
    rows = instances.join(used, "instance_id", "left")
    shown = F.coalesce(F.transform("skills", lambda s: s["content"]), F.array().cast("array<string>"))
    system, user = prompts(F.col("dataset"), F.col("question"), None if engine.endswith("progressive_disclosure") else shown)
    run = ENGINES.get(engine)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                have = [] if r.skills is None else [_plain(s) for s in r.skills]
                try:
                    got, error = run(responder, r.system or "", r.user or "", have, execute=execute, functions=functions or {}), None
                except Exception as e:  # kept with the record
                    got, error = Outcome(None, None, [s["skill_id"] for s in have]), f"{type(e).__name__}: {e}"
                out.append((r.instance_id, r.dataset, got.text, got.transcript, got.used, error))
            yield pd.DataFrame(out, columns=["instance_id", "dataset", "raw_output", "transcript", "skill_ids_used", "error"])

    return rows.select("instance_id", "dataset", "skills", system.alias("system"), user.alias("user")).mapInPandas(work, RECORDS)


# ---- experiments -------------------------------------------------------------------------

# fixed values: labels, sources and sizes of the published experiments

@dataclass(frozen=True)
class Method:
    label: str
    provider: str
    engine: str = "direct"
    source: str = ""
    k: int = 0
    n: int = 0

    def engine_for(self, dataset: str) -> str:
        if dataset != "toolqa":
            return self.engine
        return "react_progressive_disclosure" if self.engine == "progressive_disclosure" else "react"


@dataclass(frozen=True)
class Experiment:
    name: str
    methods: tuple[Method, ...] = field(default_factory=tuple)


_NONE, _ORACLE = Method("llm_direct", "none"), Method("oracle_skill", "oracle")


def _main(source: str, disclosure: str) -> tuple[Method, ...]:
    return (_NONE, _ORACLE, Method(f"{source}_top1", "topk", source=source, k=1), Method(f"{source}_select", "llm_select", source=source, k=50), Method(disclosure, "topk", "progressive_disclosure", source, 50))


_SWEEP = tuple(Method(f"bm25_top{k}", "topk", source="bm25", k=k) for k in (1, 2, 4, 8))
_SWEEP_PD = tuple(Method(f"pd_bm25_top{k}", "topk", "progressive_disclosure", "bm25", k) for k in (1, 2, 4, 8))
_NOISE = (_ORACLE, *(Method(f"oracle_d{n}", "oracle_distractor", source="bm25", n=n) for n in (2, 4, 8)))
_NOISE_PD = tuple(Method(f"pd_oracle_d{n}", "oracle_distractor", "progressive_disclosure", "bm25", n=n) for n in (0, 2, 4, 8))
EXPERIMENTS = {
    e.name: e
    for e in (
        Experiment("main", _main("bm25", "progressive_disclosure")),
        Experiment("main_linearrag", _main("linearrag", "linearrag_pd")),
        Experiment("retrieval_comparison", tuple(Method(f"{s}_top1", "topk", source=s, k=1) for s in ("bm25", "tfidf", "bge", "contriever", "rerank_bm25", "linearrag"))),
        Experiment("topk_sweep", _SWEEP + _SWEEP_PD),
        Experiment("topk_sweep_injection", _SWEEP),
        Experiment("topk_sweep_progressive_disclosure", _SWEEP_PD),
        Experiment("distractor", _NOISE + _NOISE_PD),
        Experiment("distractor_injection", _NOISE),
        Experiment("distractor_progressive_disclosure", _NOISE_PD),
    )
}


def grid(spark: SparkSession, experiment: str, datasets: list[str], sources: set[tuple[str, str]] | None = None) -> DataFrame:
    """``dataset, label, provider, engine, source``: the runs of an experiment; where
    ``sources`` is given, runs whose (dataset, source) is missing are skipped."""
    rows = [(d, m.label, m.provider, m.engine_for(d), m.source) for d in datasets for m in EXPERIMENTS[experiment].methods if not m.source or sources is None or (d, m.source) in sources]
    return spark.createDataFrame(rows, "dataset string, label string, provider string, engine string, source string")


def catalog(datasets: DataFrame) -> DataFrame:
    """``experiment, dataset, label, provider, engine, source, k, n``: the runs of every
    experiment for each row of ``datasets(dataset)``."""
    rows = [(e.name, m.label, m.provider, m.engine, m.engine_for("toolqa"), m.source, m.k, m.n) for e in EXPERIMENTS.values() for m in e.methods]
    methods = datasets.sparkSession.createDataFrame(rows, "experiment string, label string, provider string, engine string, tool_engine string, source string, k int, n int")
    engine = F.when(F.col("dataset") == "toolqa", F.col("tool_engine")).otherwise(F.col("engine"))
    # the catalog has a fixed number of rows
    out = datasets.select("dataset").distinct().join(F.broadcast(methods), F.lit(True))
    return out.select("experiment", "dataset", "label", "provider", engine.alias("engine"), "source", "k", "n")


def path_columns(workspace: str, dataset: Column, model: Column, label: Column, source: Column) -> dict[str, Column]:
    """The paths of ``paths`` for the rows of a table of runs."""
    short, root = model_short_name(model), F.lit(workspace)
    return {
        "retrieval": F.concat(root, F.lit("/retrieval/"), dataset, F.lit("-"), source, F.lit(".json")),
        "inference": F.concat(root, F.lit("/inference/"), short, F.lit("/"), label, F.lit("/"), dataset, F.lit(".jsonl")),
        "eval": F.concat(root, F.lit("/eval/"), short, F.lit("/"), label, F.lit("/"), dataset, F.lit(".json")),
    }


def paths(workspace: str, dataset: str, model: str, label: str = "", source: str = "") -> dict[str, str]:
    short = model.split("/")[-1]
    return {"retrieval": f"{workspace}/retrieval/{dataset}-{source}.json", "inference": f"{workspace}/inference/{short}/{label}/{dataset}.jsonl", "eval": f"{workspace}/eval/{short}/{label}/{dataset}.json"}


def key_values(items: list[str]) -> dict:
    """``k=v`` arguments; values are JSON where they can be."""
    import json

    out = {}
    for item in items:
        k, eq, v = item.partition("=")
        if not eq:
            raise ValueError(f"expected k=v, got {item!r}")
        try:
            out[k] = json.loads(v)
        except json.JSONDecodeError:
            out[k] = v
    return out

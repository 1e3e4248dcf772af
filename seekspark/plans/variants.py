"""Experiment variants: index variants, search configurations, and the matrix of both."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import dictionary as _dictionary  # noqa: F401  its tokenizer is one of TOKENIZERS
from seekspark.functions.text import TOKENIZERS, caption_for
from seekspark.operators.fuse import MODES


@dataclass(frozen=True)
class IndexVariant:
    """What an index is made of; queries are cut by the same tokenizer."""

    doc_lang: str = "ko"
    tokenizer: str = "word"
    embed_dim: int = 1536
    plot_doc: str = "plot"

    def __post_init__(self) -> None:
        if self.doc_lang not in ("ko", "en", "both") or self.tokenizer not in TOKENIZERS or self.plot_doc not in ("plot", "plot_kw"):
            raise ValueError(f"no such index variant: {self}")

    @property
    def name(self) -> str:
        return f"{self.doc_lang}_{self.tokenizer}_{self.embed_dim}_{self.plot_doc}"


@dataclass(frozen=True)
class SearchConfig:
    """One evaluated configuration."""

    experiment: str
    name: str
    mode: str = "hybrid"
    agent: bool = False
    w_second: float = 0.3
    w_plot: float = 0.5
    boost: float = 1.1
    top: int = 20
    max_turns: int = 2
    index: IndexVariant = IndexVariant()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no search mode {self.mode}")


def config_from(values: dict) -> SearchConfig:
    """A configuration from plain values; unknown keys are errors."""
    index_keys = {f.name for f in fields(IndexVariant)}
    own = {f.name for f in fields(SearchConfig)} - {"index"}
    if unknown := {*values} - index_keys - own:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return SearchConfig(**{k: v for k, v in values.items() if k in own}, index=IndexVariant(**{k: v for k, v in values.items() if k in index_keys}))


# The experiments that are compared, by what they set beside the defaults (those of hosted models left out).
EXPERIMENTS = (
    ("E1", "dense", {"mode": "dense"}),
    ("E1", "hybrid", {"mode": "hybrid"}),
    ("E1", "sparse", {"mode": "sparse"}),
    ("E3", "caption_both", {"doc_lang": "both"}),
    ("E3", "caption_both_agent", {"agent": True, "doc_lang": "both"}),
    ("E3", "caption_en", {"doc_lang": "en"}),
    ("E3", "caption_ko", {"doc_lang": "ko"}),
    ("E3", "caption_ko_agent", {"agent": True, "doc_lang": "ko"}),
    ("E4", "char2", {"tokenizer": "char2"}),
    ("E5", "wplot_0", {"w_plot": 0.0}),
    ("E5", "wplot_0.5", {"w_plot": 0.5}),
    ("E5", "wplot_0.5_agent", {"agent": True, "w_plot": 0.5}),
    ("E5", "wplot_0_agent", {"agent": True, "w_plot": 0.0}),
    ("E5", "wplot_1.0", {"w_plot": 1.0}),
    ("E6", "turns0", {"agent": True, "max_turns": 0}),
    ("E6", "turns1", {"agent": True, "max_turns": 1}),
    ("E6", "turns2", {"agent": True, "max_turns": 2}),
    ("E7", "dim_1536", {"embed_dim": 1536}),
    ("E7", "dim_512", {"embed_dim": 512}),
    ("FINAL", "agent", {"agent": True, "max_turns": 2}),
    ("FINAL", "search", {"mode": "hybrid"}),
    ("KW", "plot", {"doc_lang": "both"}),
    ("KW", "plot_agent", {"agent": True, "doc_lang": "both"}),
    ("KW", "plot_kw", {"doc_lang": "both", "plot_doc": "plot_kw"}),
    ("KW", "plot_kw_agent", {"agent": True, "doc_lang": "both", "plot_doc": "plot_kw"}),
    ("TOPK", "topk10_agent", {"agent": True, "top": 10}),
    ("TOPK", "topk20_agent", {"agent": True, "top": 20}),
)


def matrix() -> list[SearchConfig]:
    """A configuration for each experiment."""
    return [config_from({"experiment": e, "name": n} | values) for e, n, values in EXPERIMENTS]


def config_table(spark: SparkSession, configs: list[SearchConfig]) -> DataFrame:
    """A row for each configuration, its index variant's settings beside its own."""
    rows = [{k: v for k, v in asdict(c).items() if k != "index"} | asdict(c.index) | {"collection": c.index.name} for c in configs]
    return spark.createDataFrame(rows, "experiment string, name string, mode string, agent boolean, w_second double, w_plot double, boost double, top int, max_turns int, doc_lang string, tokenizer string, embed_dim int, plot_doc string, collection string")


def scene_texts(scenes: DataFrame, variant: IndexVariant, version: str) -> DataFrame:
    """Indexable scenes of a variant: captioned by the current model, with a text in its language."""
    valid = scenes.where(F.col("caption_ko").isNotNull() & F.col("tags").isNotNull() & (F.col("model_version") == version))
    return valid.select(F.col("id").alias("item_id"), "movie_id", caption_for(variant.doc_lang, F.col("caption_ko"), F.col("caption_en")).alias("text")).where("text != ''")

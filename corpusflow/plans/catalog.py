"""Corpus catalog: dataset keys resolved to one lazy ``(split, domain, ...)`` DataFrame.

The catalog holds builder functions, so nothing is read until a key is asked
for, and an unknown key is an error. Each corpus is *one* DataFrame with
``split`` and ``domain`` columns; the ``all`` view is a grouping, not a copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import strip_markup_expr
from corpusflow.operators.aggregates import common_length_budget
from corpusflow.operators.packing import pack_blocks
from corpusflow.operators.splits import DEFAULT_SEED, split_shuffled
from corpusflow.operators.tokens import tokenize_char
from corpusflow.plans.composite import with_all, with_mixture, with_noise, with_shuffled_tails
from corpusflow.session import ensure_parallel, input_version, session_cached

Builder = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, base: str, name: str, spread_on: str | None = None) -> DataFrame:
    """A fixture table; ``spread_on`` hash-spreads an under-partitioned scan (see ``ensure_parallel``)."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return ensure_parallel(df, spread_on) if spread_on else df


def documents_corpus(
    spark: SparkSession,
    base: str,
    domain_col: str = "source",
    val_share: float = 0.05,
    seed=DEFAULT_SEED,
) -> DataFrame:
    """``documents`` as a corpus: domain = ``source`` (or ``lang``), exact shuffled split per domain."""
    docs = table(spark, base, "documents", spread_on="doc_id").select(
        "doc_id", "text", F.col(domain_col).alias("domain")
    )
    return split_shuffled(docs, "doc_id", val_share, seed, part_cols=["domain"])


def _benchmark(spark, base):
    # a one-domain corpus: split unpartitioned, then label (a literal partition
    # column would be folded by the optimizer into a join on a constant)
    bench = table(spark, base, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return split_shuffled(bench, "doc_id", 0.1, DEFAULT_SEED).withColumn("domain", F.lit("benchmark"))


def _pages(spark, base):
    pages = table(spark, base, "pages").select(
        F.col("page_id").alias("doc_id"), strip_markup_expr(F.col("html"), "html").alias("text")
    )
    return split_shuffled(pages, "doc_id", 0.05, DEFAULT_SEED).withColumn("domain", F.lit("pages"))


class Catalog:
    """Registry of corpus builders keyed by name, and of builds that are made of other keys.

    A composed key names the keys it is made of. Resolving it walks that graph: every node is built once per
    application and version of its input, written to the shared folder, and shared by all keys that need it;
    drivers that race for a node read one build (``materialise_once``).
    """

    def __init__(self) -> None:
        self._builders: dict[str, Builder] = {}
        self._composed: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], str]] = {}

    def register(self, key: str, builder: Builder) -> None:
        self._builders[key] = builder

    def compose(self, key: str, parts: Sequence[str], build: Callable[..., DataFrame], version: str = "") -> None:
        """``build(*tables)`` of the keys ``parts``; ``version`` names its parameters."""
        unknown = [p for p in parts if p not in self._builders and p not in self._composed]
        if unknown:  # parts come first, so the graph has no cycle
            raise KeyError(f"'{key}' is made of unknown keys {unknown}")
        self._composed[key] = (tuple(parts), build, version)
        self._builders[key] = lambda spark, base: self._built(spark, key, base, {})

    def _built(self, spark: SparkSession, key: str, base: str, done: dict) -> DataFrame:
        """The table of a key; ``done`` holds the nodes of this walk."""
        if key not in self._composed:
            return self._builders[key](spark, base)
        if key not in done:
            parts, build, _ = self._composed[key]
            name = f"catalog:{key}:{self._version(key)}:{base}:{_inputs(spark, base)}"
            done[key] = session_cached(spark, name, lambda: build(*(self._built(spark, p, base, done) for p in parts)))
        return done[key]

    def _version(self, key: str) -> str:
        """Parameters of a node and of all that it is made of."""
        if key not in self._composed:
            return key
        parts, _, version = self._composed[key]
        return f"{version}({','.join(self._version(p) for p in parts)})"

    def keys(self) -> list[str]:
        return sorted(self._builders)

    def get(self, spark: SparkSession, key: str, base: str) -> DataFrame:
        name, _, domain = key.partition("-")  # split once: domains may contain '-'
        if key in self._builders:
            return self._builders[key](spark, base)
        if name in self._builders and domain:
            corpus = self._builders[name](spark, base)
            if domain == "all":
                return corpus
            found = corpus.where(F.col("domain") == domain)
            if found.select("domain").limit(1).isEmpty():
                raise KeyError(f"Unknown domain '{domain}' of dataset '{name}'")
            return found
        raise KeyError(f"Unknown dataset key '{key}'")


def _inputs(spark: SparkSession, base: str) -> str:
    """The version of the tables that composed corpora are made of."""
    return input_version(spark, f"{base}/documents.parquet")


#: Parameters of the composed corpora: ids per block, blocks of each domain's validation stream that count towards
#: ``all``, blocks that each domain gives to the shuffled mixture, span length of a mixture, seeds.
BLOCK_LEN, VAL_HEAD, TAILS, SPAN = 512, 3, {"train": 4, "val": 2}, 1000
SEEDS = {"noise": 41, "mix": 43, "tails": 47}


def compose_documents(cat: Catalog, name: str = "documents") -> None:
    """The corpora made of ``name``: its tokens and blocks, and the blocks with one more stream each.

    ``<name>+all`` adds all domains in a row, ``+noise`` tokens drawn from all training domains, ``+mix`` spans of the training
    domains at equal rates, ``+tails`` the shuffled tails that it takes from the domains.
    """
    stream = ["split", "domain"]
    cat.compose(f"{name}_tokens", [name], lambda docs: tokenize_char(docs).drop("text"), "char")
    cat.compose(f"{name}_blocks", [f"{name}_tokens"], lambda tok: pack_blocks(tok, BLOCK_LEN, stream, ["doc_id"]), str(BLOCK_LEN))
    cat.compose(f"{name}_budget", [f"{name}_tokens"], lambda tok: common_length_budget(tok).withColumnRenamed("budget", "n"))
    blocks, budget = f"{name}_blocks", f"{name}_budget"
    cat.compose(f"{name}+all", [blocks], lambda b: with_all(b, BLOCK_LEN, {"val": VAL_HEAD}), str(VAL_HEAD))
    cat.compose(f"{name}+noise", [blocks, budget], lambda b, n: with_noise(b, BLOCK_LEN, n, SEEDS["noise"]), str(SEEDS["noise"]))
    cat.compose(
        f"{name}+mix", [blocks, budget], lambda b, n: with_mixture(b, BLOCK_LEN, n, None, SPAN, SEEDS["mix"]), f"{SPAN}:{SEEDS['mix']}"
    )
    cat.compose(
        f"{name}+tails", [blocks],
        lambda b: with_shuffled_tails(b, BLOCK_LEN, TAILS, SEEDS["tails"], head={"val": TAILS["val"]}, allow_overlap=True),
        f"{TAILS}:{SEEDS['tails']}",
    )


def default_catalog() -> Catalog:
    cat = Catalog()
    cat.register("documents", lambda s, b: documents_corpus(s, b, "source"))
    cat.register("documents_lang", lambda s, b: documents_corpus(s, b, "lang"))
    cat.register("benchmark", _benchmark)
    cat.register("pages", _pages)
    cat.register(
        "documents+benchmark",
        lambda s, b: documents_corpus(s, b, "source").unionByName(_benchmark(s, b)),
    )
    compose_documents(cat)
    return cat


def corpus_catalog(spark: SparkSession, key: str, base: str, catalog: Catalog | None = None):
    """Resolve a dataset key (``name`` or ``name-domain``) to its corpus; composed keys give block tables."""
    return (catalog or default_catalog()).get(spark, key, base)

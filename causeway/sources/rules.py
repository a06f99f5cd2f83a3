"""Which corpora serve which task, and what each accepts as a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Corpora, tasks and filter values.
CORPORA = (
    "altlex",
    "because",
    "ctb",
    "esl",
    "fincausal",
    "jpfinresults",
    "jpnikkei",
    "pdtb",
    "reco",
    "semeval",
    "all",
)
SEQUENCE, SPAN, CHAIN = "sequence_classification", "span_detection", "chain_classification"
SPAN_CORPORA = ("altlex", "because", "fincausal", "jpfinresults", "pdtb", "all")
CHAIN_CORPORA = ("reco",)
FILTERS = {
    "num_sent": ("intra", "inter"),
    "num_causal": ("single", "multi"),
    "plicit": ("explicit", "implicit"),
}

# Corpora that can be filtered; others get "all" or a refusal.
BOTH_SENT_KINDS = ("ctb", "esl", "pdtb", "fincausal")
ONLY_INTER = ("jpfinresults", "jpnikkei")
BOTH_CAUSAL_KINDS = ("altlex", "because", "pdtb", "jpfinresults")
HAS_EXPLICIT = (
    "because",
    "ctb",
    "esl",
    "pdtb",
    "semeval",
    "fincausal",
    "jpfinresults",
    "jpnikkei",
)
HAS_IMPLICIT = ("altlex", "esl", "pdtb", "semeval", "fincausal")

ACCEPT, COERCE, REJECT = "accept", "all", "reject"


class RejectedOption(ValueError, AssertionError):
    """A corpus does not take this task or filter."""


def serves(corpus: str, task: str) -> bool:
    if task == CHAIN:
        return corpus in CHAIN_CORPORA
    if task == SPAN:
        return corpus in SPAN_CORPORA
    return task == SEQUENCE and corpus in CORPORA and corpus not in CHAIN_CORPORA


def filter_action(corpus: str, option: str, value: str) -> str:
    """``accept`` a filter, turn it into ``all``, or ``reject`` it.

    A filter that would keep every row anyway is turned into ``all``.
    """
    if value == "all":
        return ACCEPT
    if value not in FILTERS[option]:
        raise ValueError(f"unknown value {value!r} for {option}")
    if option == "num_sent":
        able, trivial = BOTH_SENT_KINDS, "inter" if corpus in ONLY_INTER else "intra"
    elif option == "num_causal":
        able, trivial = BOTH_CAUSAL_KINDS, "single"
    else:
        has = {"explicit": HAS_EXPLICIT, "implicit": HAS_IMPLICIT}
        if corpus not in has[value]:
            return REJECT
        other = has["implicit" if value == "explicit" else "explicit"]
        return ACCEPT if corpus in other else COERCE
    if corpus in able:
        return ACCEPT
    return COERCE if value == trivial else REJECT


def check_pair(corpus: str, task: str) -> None:
    if not serves(corpus, task):
        raise RejectedOption(f"corpus {corpus!r} has no task {task!r}")


def resolve_filters(corpus: str, **options: str) -> dict[str, str]:
    """The filters to apply for a corpus; raises when one is rejected."""
    resolved = {}
    for option, value in options.items():
        action = filter_action(corpus, option, value)
        if action == REJECT:
            raise RejectedOption(f"{option}={value!r} is not available for {corpus!r}")
        resolved[option] = value if action == ACCEPT else COERCE
    return resolved


def capability_table(spark: SparkSession) -> DataFrame:
    rows = [(c, t) for t in (SEQUENCE, SPAN, CHAIN) for c in CORPORA if serves(c, t)]
    return spark.createDataFrame(rows, "corpus string, task string")


def filter_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (corpus, option, value, filter_action(corpus, option, value))
        for option, values in FILTERS.items()
        for value in (*values, "all")
        for corpus in CORPORA
    ]
    return spark.createDataFrame(
        rows, "corpus string, filter_option string, filter_value string, action string"
    )

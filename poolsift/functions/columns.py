"""Scalar column expressions. All stay JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The label space of the postings task, in code order.
LABEL_SPACE = [
    "Contract",
    "Full-time",
    "Internship",
    "Other",
    "Part-time",
    "Temporary",
    "Volunteer",
]
# Method names of rows that describe the model before any selection.
BASE_METHODS = ["BASE", "base_classifier"]
# Smoothing term of the logarithms, token limit, decimals of every float output.
LOG_EPS = 1e-12
MAX_TOKENS = 256
DECIMALS = 6

_STRICT_JSON = {"allowSingleQuotes": "false"}


def rounded(c: Column, decimals: int = DECIMALS) -> Column:
    """Round, and turn a negative zero into zero."""
    return F.round(c, decimals) + F.lit(0.0)


def present(c) -> Column:
    """True unless null or empty; never null itself. Both halves reach a Parquet scan as filters."""
    return _col(c).isNotNull() & (_col(c) != "")


def stripped(c) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def truncate_tokens(text, limit: int = MAX_TOKENS) -> Column:
    """The first ``limit`` whitespace-separated tokens, joined by single blanks."""
    words = F.filter(F.split(_col(text), r"[ \t\n\r\f]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, limit), " ")


def label_code(label, labels) -> Column:
    """Position of the label in the label space, null when it is not in there."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), _col(label))
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_name(code, labels) -> Column:
    """Label of a code; null when the code is out of range."""
    return F.get(F.array(*[F.lit(x) for x in labels]), _col(code))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, also where ``fn`` uses it per array element."""
    return F.transform(F.array(value), fn)[0]


def not_blank(c) -> Column:
    """True when there is any visible character; stops at the first one."""
    return _col(c).rlike(r"\S")


def array_total(values) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def normalize_probs(values) -> Column:
    """Scale to sum 1; null when the sum is not positive or an entry is null."""
    def scale(p):
        return bind(array_total(p), lambda total: F.when(total > 0, F.transform(p, lambda x: x / total)))

    return bind(_col(values).cast("array<double>"), scale)


def softmax(logits) -> Column:
    def powers(z):
        return bind(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    def shares(e):
        return bind(array_total(e), lambda total: F.transform(e, lambda x: x / total))

    return bind(bind(_col(logits).cast("array<double>"), powers), shares)


def confidence(probs) -> Column:
    return F.array_max(_col(probs))


def predicted_class(probs) -> Column:
    """First position holding the largest probability, from 0."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def uncertainty(probs) -> Column:
    return F.lit(1.0) - confidence(probs)


def entropy(probs) -> Column:
    return -F.aggregate(
        _col(probs), F.lit(0.0), lambda acc, p: acc + p * F.log(p + F.lit(LOG_EPS))
    )


def normalized_entropy(probs) -> Column:
    """Entropy over the entropy of the uniform distribution."""
    classes = F.size(_col(probs)).cast("double")
    return entropy(probs) / F.log(classes + F.lit(LOG_EPS))


def _json_tries(s: Column, schema) -> tuple[Column, Column]:
    """A JSON object in the given shape, as it is and with doubled single quotes folded."""
    raw = F.when(s.rlike(r"^\s*\{"), s)
    folded = F.when(raw.contains("''"), F.replace(raw, F.lit("''"), F.lit("'")))
    return F.from_json(raw, schema, _STRICT_JSON), F.from_json(folded, schema, _STRICT_JSON)


def parse_metrics(text) -> Column:
    """JSON object -> map of doubles. Anything unreadable gives an empty map.

    Entries whose value is not a number stay in the map as null.
    """
    anything = T.MapType(T.StringType(), T.StringType())
    found = bind(_col(text), lambda s: F.coalesce(*_json_tries(s, anything)))
    known = F.coalesce(found, F.create_map().cast("map<string,string>"))
    return F.transform_values(known, lambda _, v: v.try_cast("double"))


def metrics_named(text, keys) -> Column:
    """Struct of the named entries of a JSON object as doubles, null where missing or not a number.

    Only these keys are read from the text.
    """
    wanted = T.StructType([T.StructField(k, T.StringType()) for k in keys])

    def read(s):
        first, second = _json_tries(s, wanted)
        return F.struct(*[F.coalesce(first[k], second[k]).try_cast("double").alias(k) for k in keys])

    return bind(_col(text), read)


def is_base(method) -> Column:
    """True for rows logged before any selection; a missing method is not one."""
    return F.coalesce(_col(method).isin(BASE_METHODS), F.lit(False))


def is_random(method) -> Column:
    return F.coalesce(F.lower(_col(method)).contains("random"), F.lit(False))


def model_name(name) -> Column:
    """``unknown`` for nothing; without the bracketed suffix otherwise."""
    c = _col(name)
    return (
        F.when(~present(c), F.lit("unknown"))
        .when(c.contains(" (") & c.endswith(")"), F.substring_index(c, " (", 1))
        .otherwise(c)
    )


def significance_stars(p) -> Column:
    c = _col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("ns")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c

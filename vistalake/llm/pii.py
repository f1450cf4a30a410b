"""Personal data by candidate gradient boosting, with built-in functions only.

Generators with high recall propose spans that may overlap: the base patterns of e-mail addresses, IP
addresses, card and phone numbers, and looser forms of them. Every candidate gets format features
(digits, separators, checksum or range, length) and context features (neighbouring characters, a telling word
nearby). Boosted trees learn from the candidates of the base patterns, whose checks label them, in two
folds by document: trees on the one, the precision of each threshold on the other. Candidates of the
looser forms whose score reaches their kind's threshold are added to the base spans.

The trees see all candidates, as counts of equal feature vectors: the number of vectors is bounded by
the product of the features' bins, whatever the size of the corpus, and only these counts reach the driver.
The trees come back as CASE expressions, so that scoring stays inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm import spans as S
from vistalake.llm.common import query, table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Runs are possessive and start where no run is under way (or
#: where the last match ended), which matches the same spans without going over a run again. Card
#: runs of fewer than 12 digits fail their check in any case, so the pattern leaves them out.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, by kind.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
NEAR = r"(?i)(card|visa|konto|carte|tarjeta|phone|tel|call|mobile|fax|mail|contact|write|host|server|addr|login)"
NEAR_CHARS = 24
#: The bins of each feature.
FEATURES = ("kind", "digits", "valid", "separators", "plus", "lead", "before", "after", "near", "chars")
N_TREES, DEPTH, RATE, L2 = 24, 3, 0.4, 1.0
#: A threshold is the least score at which the other fold's precision is this.
PRECISION = 0.98

CANDIDATE = "array<struct<kind:string,start:int,end:int,base:boolean,labelled:boolean,f:array<int>>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column, digits: Column) -> Column:
    """The base check of a kind."""
    n = F.char_length(digits)
    if kind == "ip":
        return match.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _bin(value: Column, edges: Sequence[int]) -> Column:
    """The number of edges that ``value`` reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)


def _describer(text: Column, kind: str, labelled: bool):
    """From a span of ``text`` to a candidate."""

    def describe(s: Column) -> Column:
        m = s["match"]
        digits = F.regexp_replace(m, "[^0-9]", "")
        n = F.char_length(digits)
        valid = _passes(kind, m, digits)
        base = valid & n.between(16, 19) if kind == "card" else valid
        left = F.substring(text, F.greatest(s["start"] - NEAR_CHARS + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR_CHARS)))
        features = F.array(
            F.lit(KINDS.index(kind)),
            _bin(n, (1, 4, 8, 10, 13, 16, 17, 20)),
            F.when(valid, 1).otherwise(0),
            _bin(F.char_length(F.regexp_replace(m, r"[^\x20().\[\]-]", "")), (1, 2, 3, 5)),
            F.when(m.startswith("+"), 1).otherwise(0),
            F.when(digits.rlike("^[3-6]"), 1).otherwise(0),
            _char_class(F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0))),
            _char_class(F.substring(text, s["end"] + 1, F.lit(1))),
            F.when(left.rlike(NEAR), 1).otherwise(0),
            _bin(F.char_length(m), (8, 12, 16, 20, 32)),
        )
        return F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (base if labelled else F.lit(False)).alias("base"),
            F.lit(labelled).alias("labelled"),
            features.alias("f"),
        )

    return describe


def candidates(text: Column) -> Column:
    """All candidates of a text, with their features."""
    parts = []
    for labelled, kind, pattern in [(True, k, BASE[k]) for k in KINDS] + [(False, *x) for x in LOOSE]:
        trigger = None
        if kind == "email":
            trigger = F.instr(text, "@") > 0 if labelled else (F.instr(text, "(at)") > 0) | (F.instr(text, "[at]") > 0)

        found = S.matches(text, pattern, kind, trigger)
        parts.append(F.transform(found, _describer(text, kind, labelled)).cast(CANDIDATE))
    return F.concat(*parts)


def fit(counts: list[tuple[tuple[int, ...], int, float, float]]) -> tuple[list, dict[str, float]]:
    """Trees and each kind's threshold, from (features, fold, rows, positives).

    Fold 0 teaches the trees, fold 1 sets the thresholds. A kind without labelled candidates there, or
    without a threshold of the wanted precision, gets an infinite one: nothing is added to it.
    """
    train = [(f, n, p) for f, fold, n, p in counts if fold == 0]
    trees: list = []
    score = [0.0] * len(train)
    for _ in range(N_TREES if train else 0):
        grads = []
        for (_, n, p), z in zip(train, score, strict=True):
            q = 1 / (1 + math.exp(-z))
            grads.append((p - n * q, n * q * (1 - q)))
        tree = _grow(train, grads, list(range(len(train))), DEPTH)
        trees.append(tree)
        score = [z + _value(tree, f) for (f, _, _), z in zip(train, score, strict=True)]
    limits = {}
    for k, kind in enumerate(KINDS):
        held = sorted(((sum(_value(t, f) for t in trees), n, p) for f, fold, n, p in counts if fold == 1 and f[0] == k), reverse=True)
        best, rows, hits = math.inf, 0.0, 0.0
        for i, (z, n, p) in enumerate(held):
            rows, hits = rows + n, hits + p
            if (i + 1 == len(held) or held[i + 1][0] < z) and hits >= PRECISION * rows:
                best = z
        limits[kind] = best
    return trees, limits


def _grow(train: list, grads: list, rows: list[int], depth: int):
    """A tree: ("leaf", value) or (feature, edge, below, at or above), by the gain of second-order boosting."""
    g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
    best = (1e-6, None, None)
    if depth:
        for j in range(len(FEATURES)):
            for edge in sorted({train[i][0][j] for i in rows})[1:]:
                gl = sum(grads[i][0] for i in rows if train[i][0][j] < edge)
                hl = sum(grads[i][1] for i in rows if train[i][0][j] < edge)
                gain = gl * gl / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2)
                if gain > best[0]:
                    best = (gain, j, edge)
    if best[1] is None:
        return ("leaf", RATE * g / (h + L2))
    _, j, edge = best
    low, high = [i for i in rows if train[i][0][j] < edge], [i for i in rows if train[i][0][j] >= edge]
    return (j, edge, _grow(train, grads, low, depth - 1), _grow(train, grads, high, depth - 1))


def _value(tree, f) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if f[tree[0]] < tree[1] else tree[3]
    return tree[1]


def _as_column(tree, f: Column) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    return F.when(f[tree[0]] < tree[1], _as_column(tree[2], f)).otherwise(_as_column(tree[3], f))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added, arrays of kind, start, end in code points.

    ``base`` are the spans of the base patterns that pass their checks; ``added`` those of looser forms that the
    trees accept and that overlap no base span, nor an added one further left, of their kind. A null or
    empty text has no spans, repeated rows give repeated results, a null id is kept, other columns are not read, an empty
    table gives no rows.
    """
    t = text_or_empty(text)
    found = written(docs.select(F.col(doc_id).alias("doc_id"), candidates(t).alias("c")))
    seen = found.select("doc_id", F.explode(F.filter("c", lambda x: x["labelled"])).alias("c"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)).cast("int")
    counts = seen.groupBy(F.col("c.f").alias("f"), F.coalesce(fold, F.lit(0)).alias("fold")).agg(F.count("*").alias("n"), F.count_if("c.base").alias("p")).collect()
    trees, limits = fit(sorted((tuple(r.f), r.fold, float(r.n), float(r.p)) for r in counts))

    limit = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(limits[k]))])
    accepted = F.filter(
        F.filter("c", lambda x: ~x["labelled"]),
        lambda x: sum((_as_column(tree, x["f"]) for tree in trees), F.lit(0.0)) >= limit[x["kind"]],
    )
    thin = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = found.select("doc_id", thin(F.filter("c", lambda x: x["base"])).alias("base"), F.array_sort(thin(accepted)).alias("more"))
    clear = F.filter("more", lambda x: ~F.exists("base", lambda b: _overlaps(x, b)))
    apart = F.aggregate(
        clear,
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda b: _overlaps(x, b)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return rows.select("doc_id", "base", apart.alias("added"))


def in_order(spans: Column) -> Column:
    """By kind as listed, then start."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("place"), s["start"].alias("at"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from what find() gives."""
    return found.select(
        "doc_id",
        *[S.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.joined(in_order(F.col("base"))), 256).alias("base_sha256"),
        S.joined(in_order(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))

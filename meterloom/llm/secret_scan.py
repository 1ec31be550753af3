"""Secret scan that links the parts of multipart credentials.

Patterns find parts: identifiers (who), secrets (proof) and endpoints (where).
The three base kinds are reported as they are. Weak kinds (an account name, a
random-looking token, an address) say nothing alone, so they are reported only
if complementary parts lie in the same scope: at most `SCOPE` code points between
the end of one and the start of the next, in the same document, either a base part
of another role, or weak parts of both other roles. Parts have no greatest length.
The link is an interval join: parts are laid out per document in the order of
their starts; the furthest end of the parts so far and the nearest start of those
to come, by role, say whether one is in scope, so no pairs are made and work per
part is constant after sorting.

Positions need no Python: the pieces between matches (`split`) and the matches
themselves (`regexp_extract_all`) alternate, so running sums of their lengths
give starts. Documents travel through one shuffle, keyed by a row number that is
only used inside that shuffle; a document is one group, however many rows share
its id.

Defined cases: a null text counts as empty and has no spans; ids may be null or
repeated, every row is judged by itself; an empty table gives an empty result.
Columns carried along keep their names; names made here start with `_ss_`,
except `spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between the end of a part and the start of the next that belong together, at most.
SCOPE = 256

_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(" + _VALUE + "+)"

#: kind, role, pattern, cheap test that some match can exist. The order is the order of report.
KINDS = (
    ("assign", "secret", _ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + _VALUE + "{8}"),
    ("access", "identifier", "AKIA[A-Z0-9]{12,}", None),
    ("hex", "secret", "[0-9a-f]{32,}", None),
    (
        "account",
        "identifier",
        r"(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|client_?id|account)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9@._-]{3,}+",
        None,
    ),
    (
        "credential",
        "secret",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])"
        r"[A-Za-z0-9+/_-]{20,}+",
        None,
    ),
    (
        "endpoint",
        "endpoint",
        r"(?<![A-Za-z0-9_])(?i:https?|ftp|ssh|jdbc:[a-z]{1,16}|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:@_-]{3,}+",
        None,
    ),
)
BASE = ("assign", "access", "hex")
ROLES = ("identifier", "secret", "endpoint")


def _matches(text: Column, order: int, pattern: str, test: str | None) -> Column:
    """Array of (order, place, gap before, length, valid) for every match of a kind."""
    pattern_col = F.lit(pattern)
    whole = F.regexp_extract_all(text, pattern_col, F.lit(0))
    valid = F.transform(whole, lambda m: F.lit(True))
    if test:  # the length of the value decides, after the match has consumed its text
        valid = F.transform(F.regexp_extract_all(text, pattern_col, F.lit(2)), lambda v: F.length(v) >= 8)
    zipped = F.arrays_zip(
        whole.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("g"), valid.alias("v")
    )
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(order).alias("order"),
            i.alias("place"),
            F.length(z["g"]).cast("long").alias("gap"),
            F.length(z["m"]).cast("long").alias("len"),
            z["v"].alias("valid"),
        ),
    )
    none = F.array().cast("array<struct<order:int,place:int,gap:bigint,len:bigint,valid:boolean>>")
    return F.when(text.rlike(test or pattern), rows).otherwise(none)


def find_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, carry=None) -> DataFrame:
    """`docs` with `spans`: array of (start, order, end, kind, base), by start, then kind, then end.

    `carry`: the columns to keep, all if not given; others do not travel.
    """
    columns = [c for c in (carry or docs.columns) if c != "spans"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    header = F.array(
        F.struct(
            F.lit(-1).alias("order"),
            F.lit(0).alias("place"),
            F.lit(0).cast("long").alias("gap"),
            F.lit(0).cast("long").alias("len"),
            F.lit(False).alias("valid"),
        )
    )
    found = F.concat(header, *[_matches(text, i, pattern, test) for i, (_, _, pattern, test) in enumerate(KINDS)])
    carried = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = (
        docs.select(carried.alias("_ss_doc"), F.monotonically_increasing_id().alias("_ss_row"), found.alias("_ss_found"))
        .select("_ss_doc", "_ss_row", F.explode("_ss_found").alias("p"))
        .select(
            F.when(F.col("p.order") == -1, F.col("_ss_doc")).alias("_ss_doc"),
            "_ss_row",
            F.col("p.order").alias("kind"),
            *[F.col(f"p.{c}").alias(c) for c in ("place", "gap", "len", "valid")],
        )
        .repartition("_ss_row")
    )
    in_order = Window.partitionBy("_ss_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_order)).withColumn(
        "start", F.col("end") - F.col("len")
    )
    rows = rows.where("valid or kind = -1")
    kind_of = F.col("kind")
    is_base = kind_of.between(0, len(BASE) - 1)
    role_kinds = {role: [i for i, k in enumerate(KINDS) if k[1] == role] for role in ROLES}
    # both frames have the part itself and those of the same start, and grow by a row at a time
    behind = Window.partitionBy("_ss_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_ss_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def within(parts: Column, room: int) -> Column:
        """One of `parts` lies at most `room` code points off; -1: they overlap."""
        last_end, next_start = F.max(F.when(parts, F.col("end"))).over(behind), F.min(F.when(parts, F.col("start"))).over(ahead)
        off = F.coalesce(F.col("start") - last_end <= room, F.lit(False))
        return off | F.coalesce(next_start - F.col("end") <= room, F.lit(False))

    in_scope = {
        role: F.when(within(kind_of.isin(kinds) & is_base, scope), 2).when(within(kind_of.isin(kinds), scope), 1)
        for role, kinds in role_kinds.items()
    }
    rows = rows.select(
        "*",
        *[F.coalesce(level, F.lit(0)).alias(f"near_{role}") for role, level in in_scope.items()],
        within(is_base, -1).alias("inside_base"),
    )
    linked = F.lit(False)
    for role, kinds in role_kinds.items():
        others = [F.col(f"near_{r}") for r in ROLES if r != role]
        linked = linked | (kind_of.isin(kinds) & ((F.greatest(*others) == 2) | (F.least(*others) >= 1)))
    names = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.greatest(kind_of, F.lit(0)) + 1)
    span = F.struct("start", kind_of.alias("order"), "end", names.alias("kind"), is_base.alias("base"))
    kept = F.when(is_base | ((kind_of >= len(BASE)) & linked & ~F.col("inside_base")), span)
    per_doc = rows.groupBy("_ss_row").agg(
        F.first("_ss_doc", ignorenulls=True).alias("_ss_doc"), F.array_sort(F.collect_list(kept)).alias("_ss_spans")
    )
    return per_doc.select(
        *[F.col("_ss_doc").getField(c).alias(c) for c in columns], F.col("_ss_spans").alias("spans")
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mark`; overlapping spans become one mark. Null texts stay null."""
    columns = docs.columns
    scanned = find_secrets(docs.withColumnRenamed("spans", "_ss_own_spans"), text_col)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def join_up(done, s):
        last = F.element_at(done, -1)
        overlaps = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.when(overlaps, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(own))
        )

    text = F.col(text_col)
    merged = F.aggregate("spans", empty, join_up)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(
        F.arrays_zip(ends.alias("a"), starts.alias("b")),
        lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")),
    )
    clean = F.when(F.size("spans") > 0, F.array_join(pieces, mark)).otherwise(text)
    out = scanned.withColumn(text_col, clean).drop("spans")
    return out.withColumnRenamed("_ss_own_spans", "spans").select(*columns)

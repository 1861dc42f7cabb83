"""Operator 10 - secret scans with multipart credential linking (native).

Base kinds are assign, access and hex: every leftmost non-overlapping match that is long
enough is reported as it stands.  Three more kinds are weak on their own: a login name or client
id (``login``), an opaque mixed-case token (``opaque``) and an address (``endpoint``).  Parts have roles:
identifiers (access, login), secrets (assign, hex, opaque) and endpoints.  A login or an opaque token that overlaps a base
span is no candidate; an endpoint may hold one, as in an address with a token.  Parts of one text
are joined by interval: a part's scope reaches ``reach`` code points to either side, bins of that
width turn the overlap into an equi-join (a part stands in every bin from its start to its end), and a weak candidate is
reported only where complementary parts lie in its scope: a login or an opaque token needs the other
role, an endpoint needs both.  An opaque token that is itself the value of a login doesn't complete it.
No kind has a longest length; an opaque token may follow '=' and may end before '.' or '-'.  A bin holds at most ``reach`` characters and so few parts, whatever the
text's length, and only texts with a weak candidate take part.

Positions come from built-in functions alone: the pieces between the matches (split) and the
matches (regexp_extract_all) alternate, so their lengths add up to offsets.  They are added up in blocks of about the square root of the
number of matches, so a log of a million matches costs a thousand blocks and not a million copies.  Weak kinds are
looked for only in texts that hold what could complete them.

Defined results: a null text is empty; texts without spans have counts 0, the hash of the
empty string and an empty span list; offsets are code points, ends exclusive; rows are judged
one by one, repeated and null ids included; an empty table gives no rows; extra columns pass
through where no output column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Weak kinds.
LOGIN = r"""(?<![A-Za-z0-9])(?i:client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
#: Base64 and base64url, 32 characters or more with a digit and both cases, but for a '-' at the end; or a signed token, whose parts are joined by dots.
OPAQUE = (
    r"(?<![A-Za-z0-9+/_.-])(?:(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2,}"
    r"|(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{31,}[A-Za-z0-9+/_]={0,2})(?![A-Za-z0-9+/=_])"
)
ENDPOINT = r"""(?i:https?|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""

KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
SPAN = "struct<start:bigint,rank:int,end:bigint>"
REACH = 200


NO_SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """array<SPAN> of the pattern's matches; keep: predicate on a match's string."""
    none = F.array().cast(NO_SPANS)

    def piece(gap, hit):
        good = hit.isNotNull() if keep is None else hit.isNotNull() & keep(hit)
        return F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("hit"), good.alias("good"))

    def state(at, spans):
        return F.struct(at.cast("bigint").alias("at"), spans.cast(NO_SPANS).alias("spans"))

    def step(s, part):
        begin = s["at"] + part["gap"]
        end = begin + part["hit"]
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"))
        return state(end, F.when(part["good"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]))

    def block_step(s, block):
        return let(F.aggregate(block, state(s["at"], none), step), lambda r: state(r["at"], F.concat(s["spans"], r["spans"])))

    def in_blocks(parts):
        width = F.ceil(F.sqrt(F.size(parts))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(parts), width)
        return F.aggregate(F.transform(firsts, lambda i: F.slice(parts, i, width)), state(F.lit(0), none), block_step)["spans"]

    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece)
    return F.when(text.rlike(pattern), let(parts, in_blocks)).otherwise(none)


def where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(NO_SPANS))


def with_spans(df: DataFrame) -> DataFrame:
    """df (..., __text) with an array of spans for each kind.

    A run of the hex or access class that is too short can't hold a longer match, so for those two
    the length may stand in the pattern; an assignment that is too short still uses up its text.  Of the weak kinds a login is
    looked for where there is an assignment sign, an opaque token where there is an identifier, an endpoint where there are both roles.
    """
    text = F.col("__text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    sign = text.contains("=") | text.contains(":")
    some = lambda *kinds: F.greatest(*(F.size(f"__{k}") for k in kinds)) > 0
    df = df.withColumns(
        {
            "__assign": where(sign, located(text, ASSIGN, 0, value)),
            "__access": where(text.contains("AKIA"), located(text, f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}", 1)),
            "__hex": located(text, f"[0-9a-f]{{{HEX_MIN},}}", 2),
            "__login": where(sign, located(text, LOGIN, 3)),
        }
    )
    df = df.withColumn("__opaque", where(some("access", "login"), located(text, OPAQUE, 4)))
    ends = some("access", "login") & some("assign", "hex", "opaque") & text.contains("://")
    return df.withColumn("__endpoint", where(ends, located(text, ENDPOINT, 5)))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, extra): the weak spans of ``found`` (row, base, weak) whose complements are in scope."""
    span = ["__row", "start", "rank", "end"]
    some = found.where(F.size("weak") > 0)
    parts = some.select("__row", F.inline(F.concat("base", "weak")))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach))).alias("bin")
    binned = parts.select("*", bins(F.col("start"), F.col("end")))
    # Logins and opaque tokens that overlap a base span are none.
    base = binned.where("rank < 3").select("__row", "bin", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hidden = binned.where("rank in (3, 4)").join(base, ["__row", "bin"]).where("b_start < end and start < b_end").select(span).distinct()
    role = F.when(F.col("rank").isin(1, 3), "id").when(F.col("rank") == 5, "endpoint").otherwise("secret")
    parts = parts.join(hidden, span, "left_anti").withColumn("role", role)
    weak = parts.where("rank >= 3").select(
        "__row",
        F.struct("start", "rank", "end").alias("span"),
        F.col("start").alias("w_start"),
        F.col("end").alias("w_end"),
        F.col("role").alias("w_role"),
        bins(F.col("start") - reach, F.col("end") + reach),
    )
    # Both sides stand in every bin that they reach, so that the interval condition alone decides.
    near = weak.join(parts.select("*", bins(F.col("start"), F.col("end"))), ["__row", "bin"]).where(
        (F.col("start") <= F.col("w_end") + reach) & (F.col("end") + reach >= F.col("w_start")) & (F.col("role") != F.col("w_role"))
    )
    apart = (F.col("end") <= F.col("w_start")) | (F.col("w_end") <= F.col("start"))
    near = near.where(apart | F.col("role").isin("endpoint") | F.col("w_role").isin("endpoint"))
    has = near.groupBy("__row", "span").agg(
        F.first("w_role").alias("w_role"),
        F.max(F.col("role") == "id").alias("id"),
        F.max(F.col("role") == "secret").alias("secret"),
    )
    complete = F.when(F.col("w_role") == "id", F.col("secret")).when(F.col("w_role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return has.where(complete).groupBy("__row").agg(F.collect_list("span").alias("extra"))


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` without its text, with n_assign, n_access, n_hex, base_sha256 and spans."""
    own = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "base", "weak", "extra", "__row", "__text", *(f"__{k}" for k in KINDS))
    rest = [c for c in docs.columns if c != text_col and c not in own]
    found = with_spans(docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text_col), F.lit("")).alias("__text")))
    found = found.select(
        *[F.col(f"`{c}`") for c in rest],
        *(F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]),
        F.array_sort(F.concat(*(f"__{k}" for k in KINDS[:3]))).alias("base"),
        F.concat(*(f"__{k}" for k in KINDS[3:])).alias("weak"),
        F.monotonically_increasing_id().alias("__row"),
    )
    found = scratch(found, "secrets")  # spans only; numbers each row for good
    out = found.join(linked(found, reach), "__row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(NO_SPANS))))
    return out.select(*[F.col(f"`{c}`") for c in rest], "n_assign", "n_access", "n_hex", F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(every).alias("spans"))


def op10_secret_scan(spark, sf_dir):
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

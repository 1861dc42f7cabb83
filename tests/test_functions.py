from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions import chunking, dates, markup, rank, text


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "s,noise",
    [("/cmd", True), (" GM ", True), ("+1", True), ("é", False), ("!!!!", True), ("!!!!!", False), ("hello", False), ("thanks", True), ("thanks a lot", False), ("__", True)],
)
def test_noise(one, s, noise):
    assert one(text.is_noise(lit(s))) is noise


@pytest.mark.parametrize("s,asks", [("How do I", True), ("show me", False), ("it broke?", True), ("can i go", True), ("Anyone know", True), ("howto", False)])
def test_question_hints(one, s, asks):
    assert one(text.is_question(lit(s))) is asks


@pytest.mark.parametrize("s,asks", [("Howé", True), ("how_", False), ("i\u017f it", True), ("doe\u017f", False), ("doe\u017fx", True), ("anyone \u212anow", True), ("\u0131s it", False), ("wherë", False)])
def test_question_hints_end_as_in_sql(one, s, asks):
    sql = __spark_entry__.oracle_sql()["question_hints"]
    rows = duckdb.sql(sql.replace("FROM conversations", "FROM (SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, $s AS text)"), params={"s": s}).fetchall()
    assert one(text.is_question(lit(s))) is asks is rows[0][2]


def test_tokens_and_keys(one):
    assert one(text.tokens(lit("A b2-B é a"))) == ["a", "b2", "b", "a"]
    assert one(text.token_set(lit("a A b"))) == ["a", "b"]
    assert one(text.tokens(lit(None).cast("string"))) == []
    assert one(text.content_key(lit("x"))) == "2d711642b726b044"
    assert one(text.question_key(lit("x"))) == "q:2d711642b726b044"


def test_slug(one):
    assert one(text.slug(lit("  How do I -- export? "))) == "how_do_i_export"
    assert one(text.slug(lit("!!!"))) == "entry"
    assert one(text.slug(lit("a" * 39 + " b"))) == "a" * 39 + "_"
    assert one(text.slug(lit("!!!"), fallback=None)) == ""


@pytest.mark.parametrize("s,term,hit", [("open the homescreen", "Home Screen", True), ("30-day window", "30 day", True), ("thirty", "30", False), ("A B", "ab", True)])
def test_mentions(one, s, term, hit):
    assert one(text.mentions(lit(s), lit(term))) is hit


def test_tidy_and_markdown(one):
    assert one(text.tidy(lit("  a \t b \n\n\n\n c  \n"))) == "a b\n\nc"
    html = 'See <a class="x" href="https://e.x/1"><b>one</b></a> and [two](https://e.x/2) or [one](https://e.x/1) <i>x</i>'
    assert one(text.inline_markdown(lit(html))) == "See [one](https://e.x/1) and [two](https://e.x/2) or [one](https://e.x/1) x"
    assert one(text.inline_markdown(lit('<a href=" /x ">  the <b> guide</b>  </a>, <A class="c" HREF=\'/y\'>z</A> and <a>none</a>'))) == "[the  guide](/x), [z](/y) and none".replace("  ", " ")
    assert one(text.inline_markdown(lit("no links < 3"))) == "no links < 3"
    links = one(text.inline_links(lit(html)))
    assert [(x.label, x.url) for x in links] == [("one", "https://e.x/1"), ("two", "https://e.x/2")]


def test_component_markup():
    src = """<script>var x</script><Markdown text="a &lt; b" /><BlogScreenshot src={x} caption="Cap" /><ExternalLink href="u">t</ExternalLink><Link path="/p">q</Link>
{#if x}<p class:on={y} onclick={z} id={w}>k</p>{/if}<a href={getUrl("/terms")}>T</a>"""
    out = markup.plain_components(src, "https://b")
    assert out.splitlines()[0] == '<pre>a &lt; b</pre><p class="figure">Screenshot: Cap</p><a href="u">t</a><a href="/p">q</a>'
    assert out.splitlines()[1] == '<p id="w">k</p><a href="https://b/terms">T</a>'


def test_component_markup_with_nested_braces_and_plain_text():
    plain = lambda s: markup.plain_components(s, "https://b")
    assert plain("<Link on:click={() => go({a: '}'})} path={p(\"/x\")} {...rest}>a</Link> if a < b {x}") == '<a href="https://b/x">a</a> if a < b {x}'
    assert plain('<!-- <Link path="x"> --><br/><img alt="a > b" src={pic}>') == '<!-- <Link path="x"> --><br /><img alt="a > b" src="pic">'
    assert plain("<style lang='x'>p { a > b }</style ><p style={\"--a: 'x'\"}>t</p>{@html y}{:else}{/each}") == "<p style=\"--a: 'x'\">t</p>"
    assert plain("<p a='1' b=2 c>x") == '<p a="1" b="2" c="">x' and plain("<p unfinished") == '<p unfinished="">'
    assert plain('<Markdown\n  text="a\n  b &quot;c&quot;"\n></Markdown>') == "<pre>a\n  b &quot;c&quot;</pre>"


def test_breadcrumb(one):
    assert one(text.breadcrumb(lit("a"), lit(None).cast("string"), lit(""), lit("b"))) == "a > b"


def test_rolled_dates(one):
    assert one(dates.rolled_date(lit(2024), lit(1), lit(31))) == date(2024, 3, 2)
    assert one(dates.rolled_date(lit(2024), lit(12), lit(1))) == date(2025, 1, 1)
    assert one(dates.rolled_date(lit(2026), lit(6), lit(26))) == date(2026, 7, 26)


def test_stale_is_strict(one):
    at = lit(datetime(2024, 10, 1)).cast("timestamp")
    assert one(dates.is_stale(F.timestamp_seconds(F.unix_seconds(at) - 270 * 86400), at)) is False
    assert one(dates.is_stale(F.timestamp_seconds(F.unix_seconds(at) - 270 * 86400 - 1), at)) is True
    assert one(dates.iso_utc(dates.from_millis(lit(1709373600000)))) == "2024-03-02T10:00:00+00:00"


@pytest.mark.parametrize("event", [0, 2_932_890, 2_932_900, 6_000_000, -720_000, -1_000_000])
def test_iso_times_of_far_years(one, event):
    sql = __spark_entry__.oracle_sql()["iso_times"].replace("FROM events", "FROM (SELECT $e::BIGINT AS event_id)")
    assert one(dates.iso_utc(dates.from_millis(lit(event).cast("bigint") * 86399000))) == duckdb.sql(sql, params={"e": event}).fetchall()[0][1]


def arr(x):
    return F.array(*[F.array(*map(F.lit, g)) for g in x])


def ids(x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "expected,got,k,recall",
    [([["a"], ["b", "c"]], ["a", "x"], 5, 0.5), ([["a"], ["b", "c"]], ["c", "b", "a"], 5, 1.0), ([["a"]], ["x", "a"], 1, 0.0), ([["a"]], [], 3, 0.0)],
)
def test_recall(one, expected, got, k, recall):
    assert one(rank.recall_at_k(arr(expected), ids(got), k)) == recall


@pytest.mark.parametrize("expected,got,rr", [([["a", "b"]], ["x", "b"], 0.5), ([["a"], ["b"]], ["b", "a"], 1.0), ([["z"]], ["x"], 0.0), ([["z"]], [], 0.0)])
def test_reciprocal_rank(one, expected, got, rr):
    assert one(rank.reciprocal_rank(arr(expected), ids(got))) == rr


def test_recall_without_groups_is_null(one):
    assert one(rank.recall_at_k(F.array().cast("array<array<string>>"), ids(["a"]), 3)) is None


def test_normalise_expected_and_citations(one):
    assert one(rank.normalise_expected(ids(["a", '["b","c"]']))) == [["a"], ["b", "c"]]
    assert one(rank.kept_citations(ids(["a", "x", "a"]), ids(["a"]))) == ["a", "a"]
    assert one(rank.unresolved(ids(["a", "x"]), ids(["a"]))) == ["x"]


def test_prose_packing(one):
    short, long_ = "a" * 700, "Sentence one is here. " * 100
    assert one(chunking.split_prose(lit("short"))) == ["short"]
    assert [len(p) for p in one(chunking.split_prose(lit("\n\n".join([short, short, short]))))] == [1402, 700]
    parts = one(chunking.split_prose(lit(long_ + "\n\n" + "tail")))
    assert all(len(p) <= 1500 for p in parts) and "".join(parts).replace(" ", "") == (long_ + "tail").replace(" ", "").replace("\n", "")
    giant = "x" * 4000
    assert one(chunking.split_prose(lit(giant + "\n\ny"))) == [giant, "y"]
    assert one(chunking.split_paragraphs(lit(long_ + "\n\ntail")))[0] == long_.strip()


def test_clause_packing_limit(one):
    assert len(one(chunking.split_clauses(lit("a" * 2000)))) == 1
    assert one(chunking.split_clauses(lit("a" * 1000 + "\n" + "b" * 1000))) == ["a" * 1000, "b" * 1000]
    assert one(chunking.split_clauses(lit("a" * 1000 + "\n" + "b" * 998 + "\nc"))) == ["a" * 1000 + "\n" + "b" * 998, "c"]


def test_short_sections_merge(spark):
    rows = [("h1", None, "a" * 100), ("h2", "s2", "b" * 300), (None, None, ""), ("h3", None, "c" * 10), (None, "s4", "d" * 10)]
    df = spark.createDataFrame([(rows,)], "s array<struct<heading:string,subheading:string,text:string>>")
    got = df.select(chunking.merge_short(F.col("s")).alias("m")).first().m
    assert [(x.heading, x.subheading, len(x.text)) for x in got] == [("h1", "s2", 402), ("h3", "s4", 22)]


def test_strip_and_tidy_as_their_patterns(spark):
    """All characters of the first plane at both ends, and mixed blanks; strip looks at the ends only."""
    codes = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    blanks = [a + b + c + "x" + d + a + "y" + b for a in " \t\n\xa0" for b in " \t\n\r" for c in " \t\n" for d in " \t\n"]
    df = spark.createDataFrame([(c + c + "a" + c + "a" + c,) for c in codes] + [(b,) for b in blanks] + [("  \n",), ("",), (None,)], "t string").coalesce(2)
    stripped = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    spaced = F.regexp_replace(F.regexp_replace("t", r"[ \t]+", " "), r" *\n *", "\n")
    tidied = F.regexp_replace(F.regexp_replace(spaced, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    wrong = df.where(~text.strip(F.col("t")).eqNullSafe(stripped) | ~text.tidy(F.col("t")).eqNullSafe(tidied))
    assert wrong.count() == 0
    plan = df.select(text.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan

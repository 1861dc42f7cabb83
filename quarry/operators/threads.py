"""Conversation threads from reply edges and time gaps, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import from_millis, is_stale, iso_utc
from ..functions.text import content_key, is_question
from ..storage import scratch
from .ordered import gap_runs

GAP_MINUTES, MAX_MESSAGES, MIN_ANSWER_CHARS = 45, 40, 60
MAX_HOPS, MIN_CONFIDENCE, STALE_DAYS = 10, 0.7, 270


def gap_sessions(df: DataFrame, ts: str, order: list, by: list[str], minutes: int = GAP_MINUTES, name: str = "session") -> DataFrame:
    """``df`` with a running number that rises where more than ``minutes`` passed since the row before.

    by: columns of the streams, each of which one task scans; ordered.gap_runs is for streams of any length.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    apart = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > minutes * 60_000_000
    return df.withColumn("__new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(name, F.sum("__new").over(w)).drop("__new")


def thread_roots(events: DataFrame) -> DataFrame:
    """(index, root): where an event's edges lead; null for loose events.

    A thread edge leads to its message in one step, or nowhere.  Reply edges are followed while
    parents exist, MAX_HOPS times at most; the last step may be a parent's thread edge.
    Index 0 is a root like any other.  The steps are taken by pointer doubling: 1, 2 and 8 of them, and none where no walk goes on.
    """
    e = events.select("index", "messageIndex", "threadRootMessageIndex", "repliesToEventIndex")
    by_message = e.where("messageIndex is not null").groupBy(F.col("messageIndex").alias("m")).agg(F.max("index").alias("at"))
    direct = e.join(by_message, F.col("threadRootMessageIndex") == F.col("m"), "left")
    # Of each event: the thread edge's target, whether there is such an edge, and the existing parent.
    ids = e.select(F.col("index").alias("p"))
    edges = direct.join(ids, F.col("repliesToEventIndex") == F.col("p"), "left").select(
        "index", F.col("threadRootMessageIndex").isNotNull().alias("threaded"), F.col("at").alias("target"), F.col("p").alias("parent")
    )
    # The walk goes to the parent and on.  A visit of a node gives the root so far and the node to visit next; visits are doubled.
    here = F.when(F.col("threaded") & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("index"))
    visit = scratch(edges.select(F.col("index").alias("at"), here.alias("found"), F.when(~F.col("threaded"), F.col("parent")).alias("then")), "visits")
    state = edges.select("index", F.when(F.col("threaded"), F.col("target")).alias("root"), F.when(~F.col("threaded"), F.col("parent")).alias("next"))
    left, hops = MAX_HOPS + 1, 1
    while left and not state.where("next is not null").isEmpty():
        if left & hops:
            met = state.join(visit, state["next"] == visit["at"], "left")
            went = F.col("next").isNotNull()
            state = scratch(met.select("index", F.when(went, F.col("found")).otherwise(F.col("root")).alias("root"), F.col("then").alias("next")), "roots")
            left -= hops
        if left:
            on = visit.select(F.col("at").alias("a2"), F.col("found").alias("f2"), F.col("then").alias("t2"))
            two = visit.join(on, F.col("then") == F.col("a2"), "left")
            visit = scratch(two.select("at", F.coalesce("f2", "found").alias("found"), F.col("t2").alias("then")), "visits")
            hops *= 2
    return state.select("index", "root")


def build_threads(events: DataFrame, channel: str | None = None) -> DataFrame:
    """(thread, index, ...) of cleaned events: edge threads first, loose messages by time gap.

    channel: column whose values are separate streams (indexes must then be unique over all of them); without it all messages are one.  Loose messages get
    a global order by ranges, so a channel may hold all of them.
    """
    by = [channel] if channel else []
    roots = thread_roots(events)
    placed = roots.where("root is not null").select(F.col("root").alias("thread"), "index")
    heads = placed.select("thread").distinct().join(events.select(F.col("index").alias("thread")), "thread", "left_semi").select("thread", F.col("thread").alias("index"))
    loose = roots.where("root is null").select("index").join(heads.select("index"), "index", "left_anti").join(events, "index")
    timed = loose.select("index", *by, from_millis(F.col("timestamp")).alias("__ts"))
    loose = gap_runs(timed, "__ts", ["index"], by, GAP_MINUTES * 60_000_000, "index").select(F.col("__first").alias("thread"), "index")
    members = placed.unionByName(heads).unionByName(loose).distinct()
    return cap_threads(members.join(events, "index"))


def cap_threads(members: DataFrame, thread: str = "thread", order: str = "index", limit: int = MAX_MESSAGES) -> DataFrame:
    w = Window.partitionBy(thread).orderBy(order)
    return members.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def shortlist(members: DataFrame, thread: str = "thread", order: str = "index", sender: str = "senderId", text: str = "text", min_answer: int = MIN_ANSWER_CHARS) -> DataFrame:
    """Threads (thread, messages) that start with a question and have a long reply and two senders."""
    w = Window.partitionBy(thread).orderBy(order)
    rows = members.withColumn("__n", F.row_number().over(w))
    groups = rows.groupBy(thread).agg(
        F.count("*").alias("messages"),
        F.max(F.when(F.col("__n") == 1, is_question(F.col(text)))).alias("__asks"),
        F.max(F.when(F.col("__n") > 1, F.length(text))).alias("__longest"),
        F.count_distinct(sender).alias("__senders"),
    )
    good = (F.col("messages") >= 2) & F.col("__asks") & (F.col("__longest") >= min_answer) & (F.col("__senders") >= 2)
    return groups.where(good).select(thread, "messages")


def sender_alias(members: DataFrame, thread: str = "thread", order: str = "index", sender: str = "senderId") -> DataFrame:
    """``members`` with alias user1, user2, ... by first appearance in the thread."""
    seen = Window.partitionBy(thread, sender)
    ranked = members.withColumn("__first", F.min(order).over(seen))
    return ranked.withColumn("alias", F.concat(F.lit("user"), F.dense_rank().over(Window.partitionBy(thread).orderBy("__first")))).drop("__first")


def render_threads(members: DataFrame, thread: str = "thread", order: str = "index", sender: str = "senderId", text: str = "text", reactions: str | None = "reactions") -> DataFrame:
    """(thread, rendered): one line per message with aliases instead of senders."""
    line = F.concat(F.lit("[event "), F.col(order), F.lit("] "), F.col("alias"), F.lit(": "), F.col(text))
    if reactions:
        pairs = F.transform(F.array_sort(F.map_entries(reactions)), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"]))
        shown = F.concat(F.lit("  [reactions: {"), F.array_join(pairs, ", "), F.lit("}]"))
        line = F.concat(line, F.when(F.size(reactions) > 0, shown).otherwise(F.lit("")))
    rows = sender_alias(members, thread, order, sender).select(thread, F.struct(F.col(order).alias("o"), line.alias("line")).alias("row"))
    return rows.groupBy(thread).agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n").alias("rendered"))


def keep_extractions(pairs: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return pairs.where(F.col("is_qa") & F.col("self_contained") & F.col("is_product_question") & (F.col("confidence") >= least))


def to_candidates(pairs: DataFrame, members: DataFrame, as_of: Column, link: str, community: str = "", channel: str = "") -> DataFrame:
    """Pending chunks of extracted pairs (thread, question, answer, answer_event_index, ...).

    The answer's event is the named one if the thread has it, else the last.  link: a format
    string with one %s for the message index.
    """
    last = members.groupBy("thread").agg(F.max("index").alias("__last"), F.min("index").alias("__root"), F.count("*").alias("thread_size"))
    named = members.select("thread", F.col("index").alias("answer_event_index"), F.lit(True).alias("__found"))
    picked = pairs.join(last, "thread").join(named, ["thread", "answer_event_index"], "left")
    picked = picked.withColumn("index", F.when(F.col("__found"), F.col("answer_event_index")).otherwise(F.col("__last")))
    full = picked.join(members.select("thread", "index", "messageIndex", "timestamp"), ["thread", "index"])
    text = F.concat(F.col("question"), F.lit("\n\n"), F.col("answer"))
    at = from_millis(F.col("timestamp"))
    return full.select(
        F.concat(F.lit("help:"), "__root").alias("id"),
        F.lit("help_channel").alias("source_type"),
        F.col("question").alias("title"),
        text.alias("text"),
        F.format_string(link, F.coalesce("messageIndex", "index").cast("string")).alias("url"),
        F.struct("question", "answer", "confidence", "self_contained", "reason", iso_utc(at).alias("answered_at"), is_stale(at, as_of, STALE_DAYS).alias("stale"), "thread_size").alias("meta"),
        F.struct(F.lit(community).alias("community_id"), F.lit(channel).alias("channel_id"), F.col("__root").alias("root_event_index"), F.col("index").alias("answer_event_index")).alias("provenance"),
        content_key(text).alias("content_hash"),
        F.lit("pending").alias("status"),
    )


def mining_counts(pairs: DataFrame) -> DataFrame:
    """One row on extracted pairs (kept, stale): kept and rejected ones, and stale ones among the kept."""
    return pairs.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if(F.col("kept") & F.col("stale")).alias("stale"))

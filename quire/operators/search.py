"""Search in postings: exact and partial terms, combined by node, ranked, cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: What a hit counts where the term only contains the query's.
PARTIAL = 0.6


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, q_idx and q of queries (query_id, query). A term that is asked twice counts twice."""
    found = queries.select("query_id", F.filter(X.tokens(F.col("query")), X.query_term).alias("qs"))
    return found.select("query_id", F.posexplode("qs").alias("q_idx", "q"))


def hits(postings: DataFrame, terms: DataFrame, index: tuple[str, ...] = ()) -> DataFrame:
    """All hits of all query terms. index: the columns that tell indexes apart; none: the postings are one index.

    Terms are looked for in the dictionary of distinct terms, not in the postings; only terms found are joined to these.
    A term that contains the query's has its first two letters as two of its own, next to each other, so terms meet on
    pairs of letters and not each with each.
    """
    first = F.struct("doc_id", "node_seq", "rank") if not index else F.struct("node_seq", "rank")
    dictionary = postings.groupBy(*index, "term").agg(F.min(first).alias("term_seq"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - 1, F.lit(1))), lambda i: F.substring("term", i, F.lit(2)))
    spread = dictionary.select(*dictionary.columns, F.explode(F.array_distinct(pairs)).alias("letters"))
    like = spread.join(terms.withColumn("letters", F.substring("q", 1, 2)), "letters").where(F.col("term").contains(F.col("q"))).drop("letters")
    like = like.withColumn("exact", F.col("term") == F.col("q"))
    found = postings.join(like, [*index, "term"])
    return found.withColumn("hit_score", F.when(F.col("exact"), F.col("score")).otherwise(F.col("score") * PARTIAL))


def search(postings: DataFrame, queries: DataFrame, top_k: int = 10, index: tuple[str, ...] = ()) -> DataFrame:
    """The top_k nodes of each query (and index) with total score, best score and the term that gave it."""
    found = hits(postings, query_terms(queries), index)
    # The order in which hits are met: query terms, exact before partial, terms as first indexed, postings by score.
    order = F.struct(F.col("q_idx"), (~F.col("exact")).alias("late"), F.when(~F.col("exact"), F.col("term_seq")).alias("seq"), (-F.col("score")).alias("neg"), F.col("doc_id"), F.col("node_seq"))
    found = found.withColumn("hit_seq", order).withColumn("key", F.coalesce("node_id", "title"))
    fields = F.struct("doc_id", "node_seq", "node_id", "title", "start_index", "end_index")
    key = ["query_id", *index, "key"] if index else ["query_id", "doc_id", "key"]
    merged = found.groupBy(*key).agg(
        F.round(F.sum("hit_score"), 9).alias("total_score"),
        F.max("hit_score").alias("score"),
        F.min_by("q", F.struct((-F.col("hit_score")).alias("neg"), "hit_seq")).alias("matched_term"),
        F.min_by(fields, "hit_seq").alias("node"),
        F.min("hit_seq").alias("first_hit"),
    )
    rank = F.row_number().over(Window.partitionBy("query_id", *index).orderBy(F.desc("total_score"), "first_hit"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "node.*", "matched_term", "score", "total_score")


def context(results: DataFrame, pages: DataFrame, nodes: DataFrame | None = None, most_chars: int = 1200) -> DataFrame:
    """query_id, context and citations: each hit's pages joined by line breaks, cut, under a line that cites it."""
    span = F.when(F.col("start_index") <= F.col("end_index"), F.sequence("start_index", "end_index"))
    wanted = results.withColumn("page_no", F.explode_outer(span))
    text = pages.select("doc_id", "page_no", F.col("text").alias("page_text")).where("page_text <> ''")
    bodies = wanted.join(text, ["doc_id", "page_no"], "left").groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.when(F.col("page_text").isNotNull(), F.struct("page_no", "page_text")))).alias("ps"))
    joined = results.join(bodies, ["query_id", "rank"])
    summary = F.lit(None).cast("string")
    if nodes is not None:
        joined = joined.join(nodes.select("doc_id", "node_seq", "summary"), ["doc_id", "node_seq"], "left")
        summary = F.col("summary")
    body = F.when(F.size("ps") > 0, F.substring(F.array_join(F.transform("ps", lambda p: p.page_text), "\n"), 1, most_chars))
    body = F.coalesce(body, summary, F.lit("(no text available)"))
    place = F.when(F.col("start_index").isNotNull() & F.col("end_index").isNotNull(), F.concat_ws("–", "start_index", "end_index")).otherwise("?")
    part = F.concat(F.lit("["), "title", F.lit(" | pages "), place, F.lit(" | score: "), F.format_string("%.2f", "total_score"), F.lit("]\n"), body)
    cite = F.struct("title", F.coalesce("node_id", F.lit("")).alias("node_id"), place.alias("pages"), F.floor(F.col("total_score") * 100 + 0.5).cast("int").alias("score"))
    packed = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), cite.alias("cite")))).alias("xs"))
    return packed.select("query_id", F.array_join(F.transform("xs", lambda x: x.part), "\n\n---\n\n").alias("context"), F.transform("xs", lambda x: x.cite).alias("citations"))


def user_turn(context: Column, question: Column) -> Column:
    """What a model is asked: the sections found, then the question."""
    found = F.when(F.length(context) > 0, F.concat(F.lit("Relevant sections:\n\n"), context))
    none = "No section matches closely. Answer from what is known of the document's structure, if possible."
    return F.concat(F.coalesce(found, F.lit(none)), F.lit("\n\nQuestion: "), question)


def last_messages(chat: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each conversation, of (conv_id, turn, role, text)."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return chat.withColumn("back", rank).where(F.col("back") <= n)


def system_turn(name: Column, description: Column | None = None) -> Column:
    """What a model is told before a conversation about a document."""
    about = F.lit("") if description is None else F.coalesce(F.concat(F.lit(" It is about: "), F.when(description != "", description)), F.lit(""))
    told = "Answer from the sections given, name the section that an answer is taken from, and say so where they hold no answer."
    return F.concat(F.lit('Questions are asked about "'), F.coalesce(name, F.lit("the document")), F.lit('".'), about, F.lit(" " + told))


def with_history(questions: DataFrame, chat: DataFrame, n: int = 10) -> DataFrame:
    """Adds `history` to questions (conv_id, turn): the last n messages (role, content) of the conversation before the turn."""
    before = chat.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    own = questions.select("conv_id", "turn").distinct()
    met = own.join(before, (F.col("conv_id") == F.col("of")) & (F.col("at") < F.col("turn")))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("at")))
    last = met.withColumn("back", rank).where(F.col("back") <= n).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "role", "content"))).alias("history"))
    told = F.transform("history", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    return questions.join(last, ["conv_id", "turn"], "left").withColumn("history", F.coalesce(told, F.array().cast("array<struct<role:string,content:string>>")))

"""Calls over batches of rows whose lists of results are put back to the rows, retrieval of queries as one unit, and chains of logged nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.model import echo, model_map
from tessera.operators.records import ordered_list

#: A call over several items: its reply lists their results.
RESULTS = ("results array<string>", 3, None)


def answered(rows: DataFrame, by: list[str], size: int, client=echo) -> DataFrame:
    """rows (by, pos from 0, item) with result and error: each batch of `size` neighbours is one call that gives a list, in their order.

    A list of another length, or a reply that is none, gives no row of that batch a result; error says what came. The results are joined back by
    place, so repeated items each get their own. pos is distinct within by; neither is null. A batch is the most that meets in a task.
    """
    keys = [*by, "_batch"]
    own = rows.withColumn("_batch", F.floor(F.col("pos") / size))
    asked = own.groupBy(*keys).agg(ordered_list("pos", F.struct("pos", "item")).alias("_rows"))
    prompt = F.to_json(F.struct(F.transform("_rows", lambda r: r["item"]).alias("items")))
    told = model_map(asked.withColumn("_p", prompt), "_p", RESULTS, client)
    n, m = F.size("_rows"), F.size("parsed.results")
    wrong = F.when(~F.col("valid") | F.col("parsed.results").isNull(), "reply can't be parsed").when(n != m, F.format_string("%d results for %d rows", m, n))
    flat = told.withColumn("_error", wrong).select(*by, "_error", F.col("parsed.results").alias("_results"), F.posexplode("_rows").alias("_i", "_row"))
    found = flat.select(*by, F.col("_row.pos").alias("pos"), F.when(F.col("_error").isNull(), F.get("_results", F.col("_i"))).alias("result"), F.col("_error").alias("error"))
    return rows.join(found, [*by, "pos"], "left")


def retrieved(queries: DataFrame, hits: DataFrame, errors: DataFrame, sources: list[str], most: int = 10) -> DataFrame:
    """query_id, query, documents (source, title, url, content) and errors of each query: what its sources found, as one unit.

    hits: query_id, source, rank, title, url, content; errors: query_id, source, message. Sources come in the order given, a source's hits by rank, `most` of
    each; of one (title, url) the first stays, hits without a title or url go. A query without documents says so among its errors, as do sources that failed.
    """
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    sound = hits.where(F.col("source").isin(*sources) & (F.length("title") > 0) & (F.length("url") > 0)).withColumn("_o", order)
    first = sound.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank", "title", "url"))).where(F.col("_n") <= most)
    one = first.groupBy("query_id", "title", "url").agg(F.min_by(F.struct("_o", "_n", "source", "content"), F.struct("_o", "_n")).alias("d"))
    lists = one.groupBy("query_id").agg(ordered_list(F.struct("d._o", "d._n"), F.struct("d.source", "title", "url", "d.content")).alias("documents"))
    wrong = errors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "source", "message"))).alias("_errors"))
    out = queries.join(lists, "query_id", "left").join(wrong, "query_id", "left")
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce("_errors", none), F.when(F.col("documents").isNull(), F.array(F.lit("no documents"))).otherwise(none))
    return out.select("query_id", "query", F.coalesce("documents", F.array().cast("array<struct<source:string,title:string,url:string,content:string>>")).alias("documents"), said.alias("errors"))


def node_chain(runs: DataFrame) -> DataFrame:
    """Log rows (thread_id, pre_node, cur_node, type, content, seq) of node runs (thread_id, seq, node, input, output): each run follows the one before it.

    A run is named by its node and place; it gives a row for its input and one for its output, where they aren't empty. The first of a thread follows nothing.
    """
    w = Window.partitionBy("thread_id").orderBy("seq")
    named = runs.withColumn("cur_node", F.concat_ws("-", "node", F.col("seq").cast("string")))
    linked = named.withColumn("pre_node", F.coalesce(F.lag("cur_node").over(w), F.lit("")))
    both = F.array(F.struct(F.lit("input").alias("type"), F.col("input").alias("content")), F.struct(F.lit("output").alias("type"), F.col("output").alias("content")))
    rows = linked.select("thread_id", "seq", "pre_node", "cur_node", F.explode(both).alias("x")).where("length(x.content) > 0")
    return rows.select("thread_id", "pre_node", "cur_node", "x.type", "x.content", "seq")

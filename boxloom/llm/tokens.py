"""Token counts of whole texts; huge documents go through overlapping chunks that are resynchronised."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import written

#: Characters of a chunk and of the first overlap. Both only steer cost: the counts don't depend on them.
CHUNK, OVERLAP = 32_768, 256


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    joins = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    return sp, joins


def _cuts(sp, joins, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Number of ids of ``text``, and its proven boundaries as (offset in characters, ids before it).

    A boundary between two characters is proven if no piece of the vocabulary holds these two side by
    side: no merge can ever join them, so whatever stands left of it can't change the ids on its right.
    """
    found, n, at = [], 0, 0
    for piece in sp.encode(text, return_type="proto").pieces:
        if 0 < at < len(text) and (not found or found[-1][0] != at):
            if text[at - 1 : at + 1].replace(" ", "▁") not in joins:
                found.append((at, n))
        n += 1
        at += len(piece.surface)
    return n, found


def _count_whole(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sp, _ = _model(path)
    for batch in batches:
        counts = [len(ids) for ids in sp.encode(batch["text"].tolist(), num_threads=1)]
        yield pd.DataFrame({"row": batch["row"], "n_tokens": counts})


def _encode_chunks(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of each chunk, with the proven boundaries in the parts that it shares with its neighbours."""
    sp, joins = _model(path)
    for batch in batches:
        out = []
        for row, k, start, body, head, tail in zip(*(batch[c] for c in ("row", "k", "start", "body", "head", "tail")), strict=True):
            n, cuts = _cuts(sp, joins, body)
            left = [{"at": start + a, "ids": i} for a, i in cuts if a < head]
            right = [{"at": start + a, "ids": i} for a, i in cuts if a >= len(body) - tail]
            out.append((row, k, n, left, right))
        yield pd.DataFrame(out, columns=["row", "k", "n", "left", "right"])


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``n_chunks`` per row of ``docs``.

    ``n_tokens`` is what the sentencepiece BPE model at ``model`` gives for the whole text, without begin
    or end ids. Texts of up to ``chunk`` characters are encoded as they are. Longer ones become chunk rows
    that overlap by ``overlap`` characters and are spread over tasks; two neighbours are spliced at the first
    proven boundary (see ``_cuts``) that both encodings have at the same offset of their overlap. Where
    they have none, the document's overlap doubles and it is encoded again, in the end as one chunk.

    Defined results: a null text counts as empty (0 bytes, 0 ids). Null and repeated ids are rows of their
    own. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.char_length(text).alias("chars"))
    short = rows.filter(F.col("chars") <= chunk)
    known = short.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("row"), "text")
    schema = f"row struct<id:{dict(rows.dtypes)['id']},n_bytes:bigint>, n_tokens long"
    whole = known.mapInPandas(lambda b: _count_whole(model, b), schema).select("row.*", "n_tokens", F.lit(1).alias("n_chunks"))
    long_rows = rows.filter(F.col("chars") > chunk)
    # a written row number: ids may be null or repeated
    todo = written(long_rows.withColumn("row", F.monotonically_increasing_id()), "long")
    done = []
    while not todo.isEmpty():
        counted = written(_spliced(todo, model, chunk, overlap), "spliced")
        done.append(counted.filter("n_tokens IS NOT NULL"))
        failed = counted.filter("n_tokens IS NULL").select("row")
        todo = written(todo.join(failed, "row", "left_semi"), "long")
        overlap *= 2
    for part in done:
        whole = whole.unionByName(part.select("id", "n_bytes", "n_tokens", "n_chunks"))
    return whole.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def _spliced(todo: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of long rows, null where two neighbours share no proven boundary."""
    step = F.lit(chunk)
    last = F.floor((F.col("chars") - 1) / step)
    # chunk k covers [k * chunk - overlap, (k + 1) * chunk + overlap); with a very wide overlap, all of the text
    wide = F.lit(overlap) >= F.col("chars")
    cut = todo.select("row", "text", "chars", F.explode(F.sequence(F.lit(0).cast("long"), F.when(wide, F.lit(0).cast("long")).otherwise(last))).alias("k"), wide.alias("wide"))
    start = F.when(F.col("wide"), 0).otherwise(F.greatest(F.lit(0), F.col("k") * chunk - overlap))
    end = F.when(F.col("wide"), F.col("chars")).otherwise(F.least(F.col("chars"), (F.col("k") + 1) * chunk + overlap))
    cut = cut.withColumns({"start": start.cast("long"), "end": end.cast("long")}).select(
        "row", "k", "start",
        F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("body"),
        F.when(F.col("k") > 0, F.least((F.col("k") * chunk + overlap), F.col("end")) - F.col("start")).otherwise(0).cast("long").alias("head"),
        F.when(F.col("end") < F.col("chars"), F.col("end") - F.greatest(F.lit(0), (F.col("k") + 1) * chunk - overlap)).otherwise(
            F.when((F.col("k") + 1) * chunk < F.col("chars"), F.col("end") - F.greatest(F.lit(0), (F.col("k") + 1) * chunk - overlap)).otherwise(0)
        ).cast("long").alias("tail"),
    )
    side = "array<struct<at:bigint,ids:bigint>>"
    coded = cut.repartition("row", "k").mapInPandas(lambda b: _encode_chunks(model, b), f"row long, k long, n long, left {side}, right {side}")
    order = Window.partitionBy("row").orderBy("k")
    near = coded.withColumn("next", F.lead("left").over(order))
    common = F.array_intersect(F.transform("right", lambda x: x.at), F.transform("next", lambda x: x.at))
    near = near.withColumn("seam", F.when(F.col("next").isNotNull(), F.get(common, F.lit(0))))
    ids_at = lambda side: F.get(F.filter(side, lambda x: x.at == F.col("seam")), F.lit(0)).ids
    near = near.withColumns({"upto": ids_at("right"), "skip": ids_at("next"), "inner": F.col("next").isNotNull()})
    # ids of chunk k between its two seams: what stands before the right seam less what stands before the left one
    parts = near.groupBy("row").agg(
        F.count("*").alias("n_chunks"), F.bool_and(~F.col("inner") | F.col("seam").isNotNull()).alias("ok"),
        F.sum(F.when(F.col("inner"), F.col("upto") - F.col("skip")).otherwise(F.col("n"))).alias("total"),
    )
    return todo.join(parts, "row").select(
        "row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("ok"), F.col("total")).alias("n_tokens"), F.col("n_chunks").cast("int").alias("n_chunks")
    )

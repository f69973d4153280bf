"""What the two compression classifiers share: raw-content dictionaries and compressed sizes.

A class is described by a zstandard dictionary of raw text. A text is cut into blocks of a
fixed number of bytes, every block is compressed with each class's dictionary, and the sizes
are summed. Blocks keep a long text from becoming its own dictionary, so all of it counts.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 6


@lru_cache(maxsize=4)
def compressors(raws: tuple[bytes, ...], level: int = LEVEL) -> list:
    """The worker's compressors for all dictionaries of a model, made once for each of the last models."""
    import zstandard

    out = []
    for raw in raws:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(raws: tuple[bytes, ...], data: bytes, block: int) -> list[int]:
    """Compressed bytes of data with each dictionary, block by block."""
    blocks = [data[i : i + block] for i in range(0, len(data), block)] or [b""]
    return [sum([len(one(b)) for b in blocks]) for one in [c.compress for c in compressors(raws)]]


def sample_ids(labelled: DataFrame, most: int) -> DataFrame:
    """(id, class, place) of at most ``most`` ids of each class, lowest MD5 of the id first.

    labelled: (id, class), no nulls. The number of a class's ids tells how low the MD5 of those
    must be that come into question, about twice ``most``; only they are shuffled and sorted.
    """
    key = F.md5(F.col("id").cast("string"))
    many = labelled.groupBy("class").agg(F.approx_count_distinct("id").alias("many"))  # as many rows as there are dictionaries
    low = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)
    likely = labelled.join(F.broadcast(many), "class").where(low * F.col("many") <= 2 * most + 50).select("id", "class").distinct()
    order = Window.partitionBy("class").orderBy(key, "id")
    return likely.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_text(sample: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sample with the text of each id; one of them where an id repeats, none where it is null."""
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return texts.join(F.broadcast(sample), "id").dropDuplicates(["id", "class"])  # sample_ids bounds the sample


def cut(data: bytes, length: int, seed: int) -> bytes:
    """A run of length bytes from a place that the seed chooses."""
    room = len(data) - length
    return data if room <= 0 else data[seed * 2654435761 % (room + 1) :][:length]

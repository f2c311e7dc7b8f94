"""Language-model scores by online logistic context mixing (see ``mixer``), next to a word-count base score.

Five steps over the texts, each one Spark pass; whatever the model learns, it
learns from all training texts:

1. one pass counts bytes, for the code tree, and picks the *head*: at most
   ``HEAD`` frequent words that get a fast path (no count comes from here);
2. one pass counts words.  Head words are summed per batch.  All other words go,
   with the documents they occur in, through one shuffle by word, which gives
   each its count over the whole training part and sends the documents' shares
   of the base score back;
3. one pass over the training texts counts contexts into tables of fixed size,
   summed over tasks in a tree;
4. one pass over the training texts counts what the predictors say and what
   comes true, in a table of fixed size summed likewise: the start weights are
   fitted on it;
5. one pass scores every text with the finished model.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import mixer
from tidewater.llm.common import ascii_words, settle, ship_package, slices, text_or_empty

#: Words in the head at most.
HEAD = 65_536
#: Documents handled at once: in the word count (fewer rows to shuffle the more there are), and in the counts of contexts.
SLICE_ROWS = 8000
MIXED_ROWS = 2000
#: A batch tells of the words that are at least one in so many of its words.
TOLD = 1 << 19
#: Bytes of text that wait, in a scoring task, for others of their length.
WAITING = 12 << 20
#: Table slices travel alone; so many partial slices are summed at a time.
SLICES = 32
FAN_IN = 32
END_WORD = b"\n"


def _held_out(key: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(texts: list[str]) -> tuple[list[bytes], pa.BinaryArray, np.ndarray, np.ndarray]:
    """The texts as the mixer sees them, their different words with a space behind each; of every word its number and its text.

    A text without words has one, which is the space alone.
    """
    joined = [b" ".join(ascii_words(t)) for t in texts]
    flat = b" ".join([*joined, b""])
    ends = np.r_[0, 1 + np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)]
    last = np.searchsorted(ends, np.cumsum([len(j) + 1 for j in joined]))  # of every text
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, last]))
    ends, kind = (ends, pa.large_binary()) if len(flat) > 1 << 30 else (ends.astype(np.int32), pa.binary())
    found = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
    return joined, found.dictionary, found.indices.to_numpy(), text


def _spaced(words: Iterable[bytes], like: pa.Array) -> pa.Array:
    return pa.array([w + b" " for w in words], like.type)


def byte_counts_and_head(train: DataFrame) -> tuple[np.ndarray, set[bytes]]:
    """Bytes of all training texts as the mixer sees them, and the head: the words told of most often, and the end."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SLICE_ROWS)):
            joined, words, which, _ = _tokens(batch.column(0).to_pylist())
            seen = np.bincount(np.frombuffer(END_WORD.join([*joined, b""]), np.uint8), minlength=256)
            n = np.bincount(which, minlength=len(words))
            n[pc.binary_length(words).to_numpy(zero_copy_only=False) == 1] = 0
            least = max(1.0, n.sum() / TOLD)
            told = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w[:-1] for w in words.take(pa.array(told)).to_pylist()] + [None] * 256, pa.binary()),
                    pa.array([None] * len(told) + list(range(256)), pa.int32()),
                    pa.array(n[told].tolist() + seen.tolist(), pa.int64()),
                ],
                names=["word", "byte", "n"],
            )

    told = settle(train.select("t").mapInArrow(tell, "word binary, byte int, n long").groupBy("word", "byte").agg(F.sum("n").alias("n")))
    counts = np.zeros(256, np.int64)
    for r in told.filter("byte is not null").collect():  # 256 rows
        counts[r["byte"]] = r["n"]
    # The head by steps of frequency, the most frequent first, as far as whole steps fit: no sort of all words in one task.
    words = told.filter("word is not null").withColumn("step", F.floor(F.log2("n") * 16))
    least, room = math.inf, HEAD - 1
    for r in sorted(words.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most 16 * 64 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = words.filter(F.col("step") >= least).select("word").collect() if least < math.inf else []
    return counts, {bytes(r["word"]) for r in top} | {END_WORD}


def _word_rows(head: set[bytes]):
    """Per batch of documents: (word, head, n_train, ids, sigs, ns); documents themselves under a name with a space."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(part for whole in batches for part in slices(whole, SLICE_ROWS)):
            ids, sigs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            held = batch.column(3).to_numpy(zero_copy_only=False)
            _, words, which, doc = _tokens(batch.column(2).to_pylist())
            train = np.bincount(which[~held[doc]], minlength=len(words))
            is_word = pc.binary_length(words).to_numpy(zero_copy_only=False) > 1
            is_head = pc.is_in(words, value_set=_spaced(head, words)).to_numpy(zero_copy_only=False)
            # The documents of each rare word, side by side.
            rare = (is_word & ~is_head)[which]
            met, times = np.unique(which[rare].astype(np.int64) * batch.num_rows + doc[rare], return_counts=True)
            column, rare_doc = np.divmod(met, batch.num_rows)
            number, sizes = np.unique(column, return_counts=True)
            docs = np.concatenate([rare_doc, np.arange(batch.num_rows)])
            ns = np.concatenate([times, np.ones(batch.num_rows, np.int64)])
            in_head = np.flatnonzero(is_word & is_head & (train > 0))
            names = [w[:-1] for w in words.take(pa.array(np.concatenate([number, in_head]))).to_pylist()]
            names = [*names[: len(number)], b" " + str(nth).encode(), *names[len(number) :], END_WORD]
            n_train = np.concatenate([train[number], [0], train[in_head], [batch.num_rows - int(held.sum())]])
            sizes = np.r_[sizes, batch.num_rows, np.zeros(len(in_head) + 1, np.int64)]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.binary()),
                    pa.array([False] * (len(number) + 1) + [True] * (len(in_head) + 1)),
                    pa.array(n_train, pa.int64()),
                    pa.ListArray.from_arrays(offsets, ids.take(pa.array(docs))),
                    pa.ListArray.from_arrays(offsets, pa.array(sigs[docs], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(ns, pa.int64())),
                ],
                names=["word", "head", "n_train", "ids", "sigs", "ns"],
            )

    return rows


def word_shares(docs: DataFrame, head: set[bytes]) -> DataFrame:
    """Counts over the training part, and each document's share from words outside the head, as rows of one table.

    Documents (``id``, ``sig``): ``log_sum`` of n * log10(count + 0.5), ``known``
    (words seen in training), ``copies`` (rows with that id and text, whose
    shares are all in the sums).  Head words (``hw``): ``tokens``.  All rows
    together: ``tokens`` and ``types`` of the training part.

    A word has at most one row per batch of documents, whatever its frequency,
    so the window by word never sees more than that.
    """
    key_type = docs.schema["k"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(head)
    found = docs.select("k", "sig", "t", "held").mapInArrow(
        lambda batches: _word_rows(held.value)(batches),
        f"word binary, head boolean, n_train long, ids array<{key_type}>, sigs array<long>, ns array<long>",
    )
    is_doc = F.col("word").substr(1, 1) == F.lit(b" ")
    # Document rows of different batches must not meet: their name gets the partition.
    found = found.withColumn("word", F.when(is_doc, F.concat("word", F.encode(F.concat(F.lit("/"), F.spark_partition_id().cast("string")), "utf-8"))).otherwise(F.col("word")))
    by_word = Window.partitionBy("word").orderBy("n_train")  # one order for both, so that rows are sorted once
    whole = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = found.withColumn("c", F.sum("n_train").over(whole)).withColumn("nth", F.row_number().over(by_word))
    each = counted.select("word", "head", "c", "nth", is_doc.alias("is_doc"), F.posexplode_outer(F.arrays_zip("ids", "sigs", "ns")))
    each = each.select("word", "head", "c", "is_doc", F.col("col.ids").alias("id"), F.col("col.sigs").alias("sig"), F.col("col.ns").alias("n"), ((F.col("nth") == 1) & (F.coalesce("pos", F.lit(0)) == 0)).alias("first"))
    share = ~F.col("is_doc") & F.col("n").isNotNull()
    return each.groupBy(F.when(F.col("head"), F.col("word")).alias("hw"), "id", "sig").agg(
        F.coalesce(F.sum(F.when(share, F.col("n") * F.log10(F.col("c") + 0.5))), F.lit(0.0)).alias("log_sum"),
        F.coalesce(F.sum(F.when(share & (F.col("c") > 0), F.col("n"))), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("is_doc"), F.col("n"))), F.lit(0)).alias("copies"),
        F.sum(F.when(F.col("first") & ~F.col("is_doc"), F.col("c")).otherwise(0)).alias("tokens"),
        F.sum(F.when(F.col("first") & ~F.col("is_doc") & (F.col("c") > 0), 1).otherwise(0)).alias("types"),
    )


def _summed(train: DataFrame, start: Callable[[], tuple[np.ndarray, Callable[[list[bytes]], None]]]) -> np.ndarray:
    """A table of fixed size over all training texts; ``start`` gives a task its empty table and what adds texts to it.

    Every task sums its texts into one table; the tables (cut in slices) are
    added ``FAN_IN`` at a time until one is left.  Few, long tasks keep the
    number of tables at a small multiple of the cores.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = None, None
        waiting, size = [], 0
        for batch in (part for whole in batches for part in slices(whole, MIXED_ROWS)):
            if table is None:
                table, add = start()
            part = batch.column(1)[0].as_py()
            for t in batch.column(0).to_pylist():
                waiting.append(b" ".join(ascii_words(t)))
                size += len(waiting[-1])
                if size >= mixer.GATHERED:
                    add(waiting)
                    waiting, size = [], 0
        if waiting:
            add(waiting)
        if part is not None:
            squeeze = zstandard.ZstdCompressor(level=1)
            flat = table.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(SLICES), pa.int32()),
                    pa.array([part] * SLICES, pa.int64()),
                    pa.array([table.dtype.str] * SLICES, pa.string()),
                    pa.array([squeeze.compress(s.tobytes()) for s in flat], pa.binary()),
                ],
                names=["slice", "part", "dtype", "load"],
            )

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(load), key[2]) for load in pdf["load"])
        return pd.DataFrame({"slice": [key[0]], "part": [key[1]], "dtype": [key[2]], "load": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    schema = "slice int, part long, dtype string, load binary"
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    parts = settle(train.select("t").coalesce(tasks).select("t", F.spark_partition_id().cast("long").alias("part")).mapInArrow(count, schema))
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("slice", "part", "dtype")
        parts = settle(grouped.applyInPandas(add_up, schema))
    table = start()[0].reshape(SLICES, -1)
    for r in parts.toLocalIterator():  # fixed size
        table[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["load"]), r["dtype"])
    return table.ravel()


def context_counts(train: DataFrame, code: mixer.Code) -> np.ndarray:
    """Context tables over all words of all training texts."""
    held = train.sparkSession.sparkContext.broadcast(code)

    def start():
        counts, own_code = mixer.Counts(), held.value
        return counts.table, lambda texts: counts.add(texts, own_code)

    return _summed(train, start).reshape(mixer.INPUTS, 2 * mixer.SLOTS)


def start_weights(train: DataFrame, code: mixer.Code, table: np.ndarray) -> np.ndarray:
    """Weights that every text starts from, fitted on all decisions of all training texts."""
    held = train.sparkSession.sparkContext.broadcast((code, mixer.left_out(table)))

    def start():
        outcomes, (own_code, cells) = mixer.Outcomes(), held.value
        return outcomes.table, lambda texts: outcomes.add(texts, own_code, cells)

    weights = mixer.fit_weights(_summed(train, start))
    held.destroy()
    return weights


def score(
    docs: DataFrame,
    folds: int = 5,
    fold: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Score every text; the model learns from rows whose crc32(key) mod ``folds`` is not ``fold``.

    Words are runs without ASCII white space, A-Z lowered; a text is its words
    and an end.  Returns key, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the words and the end), n_bytes
    and bits_per_byte of the modelled bytes.

    NULL text is empty (just the end); NULL keys belong to the training part;
    repeated rows are counted and scored each; an empty table gives an empty
    result; other columns are not carried.  Without any training text the
    tables are empty and every decision costs about one bit.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(
        F.col(key).alias("k"), F.xxhash64(text_or_empty(text)).alias("sig"), text_or_empty(text).alias("t"), _held_out(key, folds, fold).alias("held")
    )
    train = texts.filter(~F.col("held"))
    byte_counts, head = byte_counts_and_head(train)
    shares = settle(word_shares(texts, head))
    total = shares.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    train_tokens, types = total["tokens"] or 0, total["types"] or 0
    # Head words only: bounded by HEAD.
    head_logs = {bytes(r["hw"]): math.log10(r["tokens"] + 0.5) for r in shares.filter("hw is not null and tokens > 0").select("hw", "tokens").collect()}
    unseen = {w: math.log10(0.5) for w in head if w not in head_logs}
    code = mixer.code_tree(byte_counts)
    table = context_counts(train, code)
    weights = start_weights(train, code, table)
    model = spark.sparkContext.broadcast((code, mixer.logits(table), weights, head_logs, unseen))
    del table
    key_type = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_code, tables, own_weights, known, rest = model.value

        def mixed(rows: list[tuple]) -> pa.RecordBatch:
            bits = mixer.bits_of([r[0] for r in rows], own_code, tables, own_weights)
            columns = [pa.array(c, f.type) for c, f in zip(list(zip(*rows))[1:], told)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(bits)], names=[*told.names, "bits"])

        # Of head words: their share of the base score.
        heads, head_shares, no_head = None, np.array([*known.values(), *rest.values(), 0.0]), len(known) + len(rest)
        # Texts wait for others of about their length, so that no long one runs alone.
        waiting, size = defaultdict(list), Counter()
        told = None
        for batch in (part for whole in batches for part in slices(whole, MIXED_ROWS)):
            if told is None:
                told = pa.schema([("k", batch.column(0).type), ("sig", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_logs", pa.float64()), ("n_bytes", pa.int64())])
            texts, words, which, doc = _tokens(batch.column(2).to_pylist())
            if heads is None or heads.type != words.type:
                heads = _spaced(chain(known, rest), words)
            place = pc.fill_null(pc.index_in(words, value_set=heads), no_head).to_numpy(zero_copy_only=False)[which]
            n_words = np.bincount(doc, (pc.binary_length(words).to_numpy(zero_copy_only=False) > 1)[which], len(texts)).astype(np.int64)
            own = np.bincount(doc, place < len(known), len(texts)).astype(np.int64) + (END_WORD in known)
            logs = np.bincount(doc, head_shares[place], len(texts)) + known.get(END_WORD, rest.get(END_WORD, 0.0))
            for joined, k, sig, held, n, own_known, log in zip(texts, *(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(3))), n_words.tolist(), own.tolist(), logs.tolist()):
                of = len(joined).bit_length()
                waiting[of].append((joined, k, sig, held, n + 1, own_known, log, len(joined) + 1))
                size[of] += len(joined) + mixer.LANE_BYTES
                if size[of] >= mixer.SIDE_BY_SIDE:
                    yield mixed(waiting.pop(of))
                    del size[of]
            if size.total() >= WAITING:
                of, _ = size.most_common(1)[0]
                yield mixed(waiting.pop(of))
                del size[of]
        left = sorted(chain.from_iterable(waiting.values()), key=lambda r: len(r[0]))
        for a, z in mixer.blocks([r[0] for r in left], mixer.SIDE_BY_SIDE):
            yield mixed(left[a:z])

    tasks = max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 3)
    columns = f"k {key_type}, sig long, held_out boolean, n_tokens long, head_known long, head_logs double, n_bytes long, bits double"
    scored = texts.coalesce(tasks).mapInArrow(apply, columns)
    own = shares.filter("copies > 0").select("id", F.col("sig").alias("own_sig"), "log_sum", "known", "copies")
    room = math.log10(train_tokens + 0.5 * (types + 1))
    return scored.join(own, scored["k"].eqNullSafe(own["id"]) & (scored["sig"] == own["own_sig"])).select(
        F.col("k").alias(key),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.col("log_sum") / F.col("copies") - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (-F.col("bits") * F.lit(math.log10(2))).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )

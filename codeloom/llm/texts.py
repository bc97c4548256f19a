"""Operators over documents: token ids, leaked evaluation texts, pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import leaks
from codeloom.llm.bpe import Encoder, load_ranks, tokenizer_path
from codeloom.llm.pieces import cut_tokens
from codeloom.runtime import cut, small

#: Bits of the map of the items' pieces that every task gets: 2 MB, however many pieces there are.
MAP_BITS = 24
#: Rows encoded together; bounds the memory of a task.
BLOCK_ROWS = 500


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(i, BLOCK_ROWS)


def _encoders(spark, tokenizer: str, folder: str | None):
    """A broadcast of the vocabulary, a file of fixed size."""
    return spark.sparkContext.broadcast(load_ranks(tokenizer_path(tokenizer, folder)))


def token_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """doc_id, ids: every text in the ids of a byte-level BPE, without special tokens, in full and in order.

    Each task replays the merges over all new words of a block of documents at once
    and remembers their ids. Words are independent of each other, so the blocks give
    what one replay over the whole corpus would, with no shuffle of words or texts.
    Empty and null texts give the empty list; repeated rows stay.
    """
    ranks = _encoders(documents.sparkSession, tokenizer, folder)

    def run(batches):
        e = Encoder(ranks.value)
        for b in _blocks(batches):
            ids, begins = e.encode_block(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def split_texts(documents: DataFrame, limit: int = 512, overlap: int = 32, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, overlap_tokens, overlap_chars, text of every text of more than `limit` tokens.

    Pieces are numbered from 1 and are runs of at most `limit` tokens of the whole
    text's ids; each after the first begins with the last `overlap` tokens of the one
    before. Without their first overlap_chars characters the pieces make up the text.
    Smaller, empty and null texts have no pieces.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    ranks = _encoders(documents.sparkSession, tokenizer, folder)
    names = ["doc_id", "piece", "start_token", "n_tokens", "overlap_tokens", "overlap_chars", "text"]
    types = [pa.int64(), *[pa.int32()] * 5, pa.string()]

    def run(batches):
        e = Encoder(ranks.value)
        length = np.array([len(e.bytes_of.get(i, b"")) for i in range(max(e.bytes_of) + 1)], np.int64)
        for b in _blocks(batches):
            # a token has a byte at least, so a text of no more bytes needs no encoding
            rows = [(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and (len(t) > limit or len(t.encode("utf-8")) > limit)]
            ids, begins = e.encode_block([t for _, t in rows])
            out = []
            for k in np.nonzero(np.diff(begins) > limit)[0].tolist():
                key, text = rows[k]
                starts = [0, *np.cumsum(length[ids[begins[k] : begins[k + 1]]]).tolist()]
                ascii_, raw = text.isascii(), text.encode("utf-8")
                cuts = cut_tokens(text, starts, limit, overlap, ascii_, raw)
                for p in range(1, len(cuts)):
                    again = overlap if p > 1 else 0
                    s, at, end = cuts[p - 1] - again, starts[cuts[p - 1]], starts[cuts[p]]
                    before = raw[starts[s] : at].decode("utf-8", "ignore")
                    out.append((key, p, s, cuts[p] - s, again, len(before), before + raw[at:end].decode("utf-8", "ignore")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start_token int, n_tokens int, overlap_tokens int, overlap_chars int, text string")


def _item_texts(items: DataFrame) -> DataFrame:
    """item_id, text (a key of its words), words: what each item says beside an instruction that several share.

    An instruction is a sentence that opens several texts, all of which go on after it.
    """

    def run(batches):
        hashes = leaks.Hashes()
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, *rest = leaks.sentences_of(text, hashes)
                after = np.concatenate(rest) if rest else first[:0]
                rows.append((item, leaks.text_key(first), leaks.text_key(np.concatenate((first, after))), first.tolist(), after.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["item_id", "opening", "text", "first", "after"])

    schema = "item_id long, opening long, text long, first array<long>, after array<long>"
    said = cut(items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema).distinct())
    # a key of the text counts once however many items have it, before the openings are gathered
    openings = said.groupBy("opening", "text").agg(F.min(F.size("after")).alias("n")).groupBy("opening").agg(F.count("*").alias("texts"), F.min("n").alias("n"))
    shared = small(cut(openings.filter("texts > 1 AND n > 0").select("opening", F.lit(True).alias("shared"))))
    words = F.when(F.col("shared"), F.col("after")).otherwise(F.concat("first", "after"))
    return said.join(shared, "opening", "left").select("item_id", "text", words.alias("words"))


def _item_parts(texts: DataFrame) -> DataFrame:
    """text, part, words, pieces (keys by place): the stretches of the items' texts."""

    def run(batches):
        for b in batches:
            rows = []
            for text, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.array(words, np.int64)
                for part, (x, y) in enumerate(leaks.stretches_of(len(w))):
                    rows.append((text, part, words[x:y], leaks.piece_keys(w[x:y]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["text", "part", "words", "pieces"])

    distinct = texts.filter(F.size("words") >= leaks.LEAST).groupBy("text").agg(F.first("words").alias("words"))
    return distinct.mapInArrow(run, "text long, part int, words array<long>, pieces array<long>")


def _piece_map(pieces: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the piece keys by their first `bits` bits: 2 ** (bits - 5) numbers at most come to the driver."""
    slots = pieces.select(F.shiftrightunsigned("piece", 64 - bits).alias("slot"))
    words = slots.groupBy(F.expr("cast(slot >> 5 as int)").alias("at")).agg(F.expr("bit_or(1L << cast(slot & 31 as int))").alias("ones"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toArrow()
    out[found["at"].to_numpy()] = found["ones"].to_numpy().astype(np.uint32)
    return out


#: SHARED pieces lie near enough for one passage, and as far apart in the item as in the text but for its errors.
_CLUSTERED = f"""exists(hits, h -> size(array_distinct(transform(filter(hits, x -> x.at >= h.at AND x.at <= h.at + {leaks.REACH - leaks.PIECE}
    AND abs((x.at - x.place) - (h.at - h.place)) <= {leaks.LONGEST // leaks.RATE}), x -> x.at))) >= {leaks.SHARED})"""


def leaked_items(documents: DataFrame, items: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """doc_id, item_id: documents that hold a passage of an evaluation item.

    A passage has at least 12 words of the item in order, and at most one in five
    changed, dropped or added. By the pigeonhole principle it shares exact pieces of
    three words with its item, four at least. One scan of the documents, for any
    number of items, leaves the stretches of 128 words where so many of some item's
    pieces may be, by a bitmap of fixed size; these are joined with the items' pieces,
    and Myers' bit-parallel distance decides for each pair of a stretch and a part of
    an item. Equal stretches and equal texts are compared once.

    A passage shows the item that it is nearest to: it counts for the item with the fewest
    errors in some window of 12 words of the passage (for several items only if they all
    hold the window word for word), and for each item that is near as a whole: of whose
    pieces the stretch has one in three. Items compete where they share four pieces or
    more near each other. So a passage that stands in an item word for word always counts
    for it, and turns of phrase around other names do not.
    What is taken out of items is only the instruction that opens
    several of them. Null and empty texts hold and leak nothing; repeated rows give
    one row.
    """
    spark = documents.sparkSession
    texts = cut(_item_texts(items))
    parts = cut(_item_parts(texts))
    pieces = parts.select("text", "part", F.posexplode("pieces").alias("place", "piece"))
    known = spark.sparkContext.broadcast(_piece_map(pieces, map_bits))

    def scan(batches):
        hashes = leaks.Hashes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    w = hashes.of(leaks.words_of(text))
                    for x, y in leaks.suspects(w, known.value, map_bits):
                        rows.append((doc, leaks.text_key(w[x:y]), w[x:y].tolist(), leaks.piece_keys(w[x:y]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc_id", "stretch", "here", "pieces"])

    found = cut(documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, stretch long, here array<long>, pieces array<long>"))
    stretches = cut(found.groupBy("stretch").agg(F.first("here").alias("here"), F.first("pieces").alias("pieces")))
    hits = stretches.select("stretch", F.posexplode("pieces").alias("at", "piece")).join(small(cut(pieces)), "piece")
    # of one stretch and one part, at most STRETCH ** 2 places
    pairs = hits.groupBy("stretch", "text", "part").agg(F.sort_array(F.collect_list(F.struct("at", "place"))).alias("hits")).filter(F.size("hits") >= leaks.SHARED)
    pairs = pairs.filter(F.expr(_CLUSTERED))
    pairs = pairs.join(small(parts.select("text", "part", "words", F.size("pieces").alias("of"))), ["text", "part"]).join(stretches.select("stretch", "here"), "stretch")

    def decide(batches):
        for b in batches:
            rows = []
            for stretch, text, of, words, here, at, place in zip(*(b.column(i).to_pylist() for i in range(7))):
                if spans := leaks.regions(at, place, len(here), len(words)):
                    holds, like = leaks.compare(words, here, spans)
                    rows.append((stretch, text, holds, holds and leaks.NEAR * len(set(place)) >= of, [{"place": p, "errors": e, "inside": i} for p, e, i in like]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["stretch", "text", "holds", "near", "like"])

    types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("place", pa.int16()), ("errors", pa.int16()), ("inside", pa.bool_())])))
    # few bytes and much work: spread by the number of cores, not by size
    pairs = pairs.select("stretch", "text", "of", "words", "here", "hits.at", "hits.place").repartition(2 * spark.sparkContext.defaultParallelism, "stretch", "text", "place")
    compared = cut(pairs.mapInArrow(decide, "stretch long, text long, holds boolean, near boolean, like array<struct<place short, errors short, inside boolean>>"))
    windows = compared.select("stretch", "text", "near", F.explode("like").alias("w")).select("stretch", "text", "near", "w.*")
    least = windows.groupBy("stretch", "place").agg(F.min(F.struct("errors", "text")).alias("a"), F.max(F.struct(-F.col("errors"), "text")).alias("b"))
    least = least.select("stretch", "place", F.col("a.errors").alias("least"), (F.col("a.text") == F.col("b.text")).alias("alone"))
    nearest = windows.filter("inside AND NOT near").join(least, ["stretch", "place"]).filter("errors = least AND (alone OR errors = 0)").select("stretch", "text")
    shown = compared.filter("near").select("stretch", "text").unionByName(nearest).distinct()
    return found.select("doc_id", "stretch").join(shown, "stretch").join(texts.select("text", "item_id"), "text").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, n_documents: how many documents each leaked item stands in."""
    n = leaked_items(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return n.join(items.groupBy("item_id").agg(F.max("suite").alias("suite")), "item_id").select("item_id", "suite", "n_documents")

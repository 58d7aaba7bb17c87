"""Encoding a corpus with a public byte-level BPE tokenizer, inside Spark expressions.

The vocabulary becomes a constant rank map: an array of small maps, addressed by a
hash, so a lookup costs the same however large the vocabulary is.  A word starts as its
bytes; a fold merges, step by step, the leftmost pair of lowest rank.  The ids of frequent
distinct words are folded once and become a second constant map; a document is then
encoded in place, without a shuffle, and only rare words are folded where they stand.
Words of hundreds of bytes, which scripts without blanks have, are merged with a heap in
Arrow batches, where length costs no square.  Bytes are written in hexadecimal, where joining
pieces is joining strings.

Constants reach the expressions as scalar subqueries: their values travel as flat memory,
where literals would travel as millions of objects with every task.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from heliograph.functions.binding import let

#: Folder of the vocabulary files; nothing is copied from it.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the pattern that splits a text before merging, as its vocabulary's makers state it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the literal word map, whatever the size of the corpus.
DICTIONARY_WORDS, DICTIONARY_BYTES = 1 << 14, 48
SLOTS = 1 << 14
#: Bytes up to which a word is folded: the steps of a fold copy its pieces.
LONGEST_FOLD = 256


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[str, int]:
    """Hexadecimal bytes -> id, from a file of base64 bytes and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece).hex().upper(): int(rank) for piece, rank in map(bytes.split, lines)}


def _with_constants(rows: DataFrame, expression: Callable[..., Column], **constants: tuple[object, str]) -> DataFrame:
    """``rows`` with ``hg_result``, made by an expression that is given the constants as columns.

    A subquery may not stand within a higher-order function as it is written, but the
    optimizer puts it there from the projection below, where it is used once.
    """
    spark, kept = rows.sparkSession, rows.columns
    named = {f"hg_{n}": spark.createDataFrame([(value,)], f"value {kind}").scalar() for n, (value, kind) in constants.items()}

    def nested(names: list[str], given: list[Column]) -> Column:
        return let(F.col(names[0]), lambda c: nested(names[1:], [*given, c])) if names else expression(*given)

    return rows.select("*", *(c.alias(n) for n, c in named.items())).select(*(F.col(f"`{c}`") for c in kept), nested(list(named), []).alias("hg_result"))


def _slots(entries: dict[str, object]) -> list[dict]:
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[xxhash.xxh64_intdigest(key.encode(), 42) & (SLOTS - 1)][key] = value  # as Spark hashes a string
    return slots


def _lookup(slots: Column, key: Column) -> Column:
    return F.try_element_at(F.get(slots, F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1)).cast("int")), key)


class Tokenizer:
    """Column expressions for one vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZER_DIR):
        self.ranks = load_ranks(os.path.join(folder, name))
        self._words: list[dict] | None = None
        #: Whether documents may have words that are too long to fold.
        self._long = True

    def _rank_map(self) -> tuple[list[dict], str]:
        return _slots(self.ranks), "array<map<string,int>>"

    def words(self, text: Column) -> Column:
        """The pieces of text that are merged separately; together they are the text."""
        return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def fold(self, key: Column, ranks: Column) -> Column:
        """Ids of a word given as hexadecimal bytes, by the rank map.

        The state is the pieces, the rank of every pair of neighbours, and the lowest of these.
        A step merges the leftmost pair of that rank and looks up the two pairs it makes, so
        a word of n bytes takes at most 3 n lookups.
        """

        def state(pieces: Column, of_pairs: Column) -> Column:
            return let(of_pairs, lambda found: F.struct(pieces.alias("pieces"), found.alias("ranks"), F.array_min(found).alias("best")))

        def start(pieces: Column) -> Column:
            pairs = F.greatest(F.size(pieces) - 1, F.lit(0))
            return state(pieces, F.zip_with(F.slice(pieces, 1, pairs), F.slice(pieces, 2, pairs), lambda a, b: _lookup(ranks, F.concat(a, b))))

        def step(now: Column, _: Column) -> Column:
            pieces, of_pairs, none = now["pieces"], now["ranks"], F.array().cast("array<int>")

            def at(place: Column) -> Column:
                def merged(piece: Column) -> Column:
                    left = F.when(place > 1, F.array(_lookup(ranks, F.concat(F.get(pieces, place - 2), piece)))).otherwise(none)
                    right = F.when(place < F.size(of_pairs), F.array(_lookup(ranks, F.concat(piece, F.get(pieces, place + 1))))).otherwise(none)
                    joined = F.concat(F.slice(pieces, F.lit(1), place - 1), F.array(piece), F.slice(pieces, place + 2, F.size(pieces)))
                    beside = F.concat(F.slice(of_pairs, F.lit(1), F.greatest(place - 2, F.lit(0))), left, right, F.slice(of_pairs, place + 2, F.size(pieces)))
                    return state(joined, beside)

                return let(F.concat(F.get(pieces, place - 1), F.get(pieces, place)), merged)

            return F.when(now["best"].isNull(), now).otherwise(let(F.array_position(of_pairs, now["best"]).cast("int"), at))

        def whole(pieces: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - 1))
            return F.aggregate(steps, start(pieces), step, lambda s: F.transform(s["pieces"], lambda p: _lookup(ranks, p)))

        return let(F.regexp_extract_all(key, F.lit(".."), F.lit(0)), whole)

    def learn_words(self, documents: DataFrame, text_col: str = "text") -> None:
        """Folds the most frequent distinct words of the whole corpus once.

        At most DICTIONARY_WORDS words of at most DICTIONARY_BYTES bytes come to the
        driver; it saves time only and changes no result.  What is learnt holds for these documents.
        """
        spark = documents.sparkSession
        seen = Observation()
        words = documents.select(F.explode(self.words(F.col(text_col))).alias("word")).observe(seen, F.max(F.octet_length("word")).alias("longest"))
        counted = words.where(F.octet_length("word") <= DICTIONARY_BYTES).groupBy("word").agg(F.count("*").alias("n"))
        frequent = counted.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).select("word")
        spread = frequent.repartition(spark.sparkContext.defaultParallelism, "word")
        folded = _with_constants(spread, lambda ranks: self.fold(F.hex("word"), ranks), ranks=self._rank_map())
        self._words = _slots({r.word: r.hg_result for r in folded.collect()})
        self._long = (seen.get["longest"] or 0) > LONGEST_FOLD

    def encode(self, documents: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """``documents`` with the ids of a text, without special tokens; null and empty texts give
        an empty list."""
        return self._over_words(documents, text_col, ids_col, F.flatten, F.array().cast("array<int>"))

    def count(self, documents: DataFrame, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
        """``documents`` with the number of ids of a text."""
        return self._over_words(documents, text_col, count_col, lambda ids: F.aggregate(ids, F.lit(0), lambda n, x: n + F.size(x)), F.lit(0))

    def _over_words(self, documents: DataFrame, text_col: str, into: str, result: Callable[[Column], Column], empty: Column) -> DataFrame:
        text = F.col(f"`{text_col}`")
        if self._long:
            long = F.array_distinct(F.filter(self.words(text), lambda w: F.octet_length(w) > LONGEST_FOLD))
            # A long word has a run of so many letters, or of so much white space; few texts have.
            run = LONGEST_FOLD // 4 - 1
            documents = documents.withColumn("hg_long", self._merge_long()(F.when(text.rlike(rf"(?U)\S{{{run}}}|\s{{{run}}}"), F.when(F.size(long) > 0, long))))

        def ids_of(ranks: Column, known: Column) -> Column:
            def ids(word: Column) -> Column:
                short = F.coalesce(_lookup(known, word), self.fold(F.hex(word), ranks))
                return short if not self._long else F.when(F.octet_length(word) > LONGEST_FOLD, F.try_element_at("hg_long", word)).otherwise(short)

            return F.coalesce(result(F.transform(self.words(text), ids)), empty)

        known = self._words or [{}] * SLOTS, "array<map<string,array<int>>>"
        found = _with_constants(documents, ids_of, ranks=self._rank_map(), known=known)
        kept = [F.col(f"`{c}`") for c in documents.columns if c not in (into, "hg_long")]
        return found.select(*kept, F.col("hg_result").alias(into))

    def _merge_long(self):
        ranks = {bytes.fromhex(k): r for k, r in self.ranks.items()}

        @F.arrow_udf("map<string,array<int>>")
        def merge_long(words: pa.Array) -> pa.Array:
            kind = pa.map_(pa.string(), pa.list_(pa.int32()))
            return pa.array([None if row is None else [(w, merged_ids(w.encode(), ranks)) for w in row] for row in words.to_pylist()], kind)

        return merge_long

    def decode(self, documents: DataFrame, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
        """``documents`` with the text of a list of ids: their bytes joined.  Null gives null."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for key, rank in self.ranks.items():
            pieces[rank] = key
        joined = _with_constants(documents, lambda table: F.array_join(F.transform(F.col(f"`{ids_col}`"), lambda i: F.element_at(table, i + 1)), ""), table=(pieces, "array<string>"))
        kept = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
        return joined.select(*kept, F.decode(F.unhex("hg_result"), "utf-8").alias(text_col))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs over a linked list: n log n for n bytes."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if not piece[i] or j == n or len(piece[i]) + len(piece[j]) != size:
            continue  # one of the two has been merged since
        piece[i] += piece[j]
        piece[j], after[i] = b"", after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (r := ranks.get(piece[left] + piece[right])) is not None:
                heapq.heappush(heap, (r, left, len(piece[left]) + len(piece[right])))
    return [ranks[p] for p in piece if p]


def count_tokens(documents: DataFrame, tokenizer: Tokenizer | None = None, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of ids of every text, which are not built."""
    tokenizer = tokenizer or Tokenizer()
    tokenizer.learn_words(documents, text_col)
    return tokenizer.count(documents, text_col, count_col)


def encode_documents(documents: DataFrame, tokenizer: Tokenizer | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``documents`` with the ids of every text in ``ids_col``.

    Works on whole texts of any length, repeated rows and empty tables; a column already
    called ``ids_col`` is replaced.
    """
    tokenizer = tokenizer or Tokenizer()
    tokenizer.learn_words(documents, text_col)
    return tokenizer.encode(documents, text_col, ids_col)

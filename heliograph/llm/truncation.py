"""Text cut off by field limits or in transfer.

A text that lacks its end stops inside a word or a sentence that goes on in other
places.  Whole texts rarely have a longer copy, so the prefix self-join is made on
their tails: the last tokens of every text without a proper end are hashed, and the
hashes are looked up among the windows of fixed length, and the word prefixes, of all
texts.  A tail that elsewhere goes on, but hardly ever ends a sentence there, was cut;
one that elsewhere ends sentences only lost its full stop.  Whole texts are joined too:
sorted without the marks of cuts, a text with a longer copy is followed by it.  Lengths at which a source's
unfinished texts pile up are its field limits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.runtime import materialise, trimmed_lower

# Marks that end a sentence, and marks that stand for a cut.
ENDS = ".!?。！？؟।"
CUT_MARK = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\))\s*\Z")
#: Scripts written without blanks: there every letter is a token.
DENSE = "぀-ヿ㐀-鿿가-힣฀-๿"
#: Marks inside a sentence are left out: writers without punctuation say the same words.
TOKEN = re.compile(rf"[{DENSE}]|[^\W{DENSE}_]+(?:['’\-][^\W{DENSE}_]+)*|[{re.escape(ENDS)}…]")
DENSE_ONE = re.compile(rf"[{DENSE}]")
NUMBER = re.compile(r"\d+")
#: An escape, a tag or a character that was begun and not ended.
BROKEN = re.compile(r"(?:&(?:#x?[0-9a-fA-F]{0,6}|am?p?|lt?|gt?|qu?o?t?|nb?s?p?|apo?s?)|(?<!\s)&|\\u[0-9a-fA-F]{0,3}|<[a-zA-Z/!][^<>]{0,12}|\ufffd+|\u200d)\Z")
MARKUP = re.compile(r"<[a-zA-Z/][^<>]{0,40}>")
CLOSED = re.compile(rf"[{re.escape(ENDS)}][^\w{re.escape(ENDS)}]*\Z")
#: Ends of sentences in other scripts; marks that close a part, end a line or draw a face.
CLOSING = frozenset("｡۔։።။៕॥᠃׃‼⁇⁈⁉‥*~>|")
#: Classes of closing brackets and quotes, of emoji, and of their modifiers.
CLOSING_CLASSES = frozenset(("Pe", "Pf", "So", "Sk"))
#: Faces that end like an open bracket or a slash, and dots of Japanese writers.
FACE = re.compile(r"(?:[:;=][\-'’^o]?[(\[{]+|(?:^|\s)>?[:;=][\-'’^o]?[/\\&$#@,]|[、・･]{2,})\Z")
GOES_ON = re.compile(r"\w|[,;:]?\s+\w|[\-'’]\w|[、，；：]\s*\w")
#: A last line of a word or two.
SIGNED = re.compile(r"[^\S\r\n]*[\r\n]\s*\w+(?:[^\S\r\n]+\w+)?\s*\Z")
NAMED = re.compile(rf"[{re.escape(ENDS)}…]\s*[-–—~]+\s*\w+\Z")
#: Lengths of the windows looked up, longest first; for dense scripts the long ones only.
WINDOWS = (8, 6, 5, 4, 3, 2)
DENSE_WINDOWS = (8, 6, 5)
#: Numbers of tokens before a broken word that are looked up with it.
CONTEXTS = (3, 2, 1)
LONGEST_PREFIX = 32
#: Longer runs of tokens that no end mark closes tell nothing about where sentences end: their
#: writer uses no marks.
LONGEST_RUN, LONGEST_DENSE_RUN = 24, 80
#: A shorter text without a sentence's end is a few words, not a cut sentence.
FEW_WORDS = 6
#: Letters a task looks at together, and letters of a piece of a long text.
LETTERS_AT_ONCE, PIECE = 1 << 20, 1 << 20
#: Bits of the filter of hashes that are looked up, FILTER_SHARE for each: 128 KB to 256 MB.
#: Beyond some 1e8 lookups it lets more and more through, which costs time and changes no result.
FEWEST_BITS, MOST_BITS, FILTER_SHARE = 20, 31, 16
BLOCK_BITS = 15  # of Spark's bitmap functions
#: Letters two texts must share to be compared as wholes.
COPY_KEY = 16
#: A field limit: so many unfinished texts of one length, so many times the lengths around.
LEAST_AT_LIMIT, PEAK, NEIGHBOURS, BAND, SHORTEST_LIMIT = 5, 8.0, 8, 5, 60
#: Occurrences a window needs to count as evidence.
SUPPORT, PAIR_SUPPORT, PAIR_SHARE = 3, 20, 0.02
#: A word prefix must make up such a part of what follows its context.
RARE = 0.002
#: Share of sentence ends up to which a tail counts as cut: plain, with a mark of a cut, at a limit.
OPEN_END, WITH_MARK, AT_LIMIT = 0.25, 0.4, 0.7

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
FULL = (1 << 64) - 1
#: Tells the key of what follows a window from the key of a window.
AFTER = 77


def _mix(a: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * _M) ^ (np.asarray(b, np.uint64) + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * _N
        return x ^ (x >> np.uint64(29))


def _clean(text: str) -> str:
    """Lower-cased, with markup and entities resolved and letters composed with their accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub(" ", text)
    return unicodedata.normalize("NFC", text.lower())


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, cleaned; every number is the token 0."""
    return TOKEN.findall(NUMBER.sub("0", _clean(text)))


#: Base of the polynomial hash of a word over its letters, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _letter(code):
    """A number without pattern for a letter; of one code point or an array of them."""
    if isinstance(code, int):
        return _mix_one(code, 0xD6E8FEB86659FD93)
    return _mix(code.astype(np.uint64), 0xD6E8FEB86659FD93)


def _sealed(total, length):
    """The hash of so many letters from their polynomial's value."""
    return _mix_one(total, length) if isinstance(total, int) else _mix(total, length.astype(np.uint64))


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> int:
    total, power = 0, 1
    for c in word:
        total, power = total + _letter(ord(c)) * power & FULL, power * BASE & FULL
    return _sealed(total, len(word))


OTHER, WORD, DENSE_LETTER, JOINER, END, DIGIT, UNKNOWN = range(7)


class Letters:
    """Classes of letters as ``TOKEN`` has them, looked up once for each that occurs."""

    def __init__(self) -> None:
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        new = codes[found == UNKNOWN]
        if len(new):
            for c in set(new.tolist()):
                self.classes[c] = self._class(chr(c))
            found = self.classes[codes]
        return found

    @staticmethod
    def _class(c: str) -> int:
        if DENSE_ONE.match(c):
            return DENSE_LETTER
        if NUMBER.match(c):
            return DIGIT
        if c.isalnum():
            return WORD
        return JOINER if c in "'’-" else END if c in ENDS + "…" else OTHER

    def scale(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, from 0 to n."""
        if len(self.powers) <= n:
            with np.errstate(over="ignore"):
                self.powers, self.inverses = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + n // 2, b, np.uint64))]) for b in (BASE, INVERSE))
        return self.powers, self.inverses


class Tokens:
    """The tokens of many cleaned texts as arrays; the same tokens that ``tokens_of`` gives."""

    def __init__(self, letters: Letters, texts: list[str]):
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes)]
        kind = letters.of(codes)
        # A run of digits is one 0.
        digit = kind == DIGIT
        keep = ~(digit & np.append(False, digit[:-1]))
        codes, kind, text_of = np.where(digit, np.uint32(48), codes)[keep], np.where(digit, WORD, kind)[keep], text_of[keep]
        word = kind == WORD
        joined = (kind == JOINER) & np.append(False, word[:-1]) & np.append(word[1:], False)
        word |= joined
        single = (kind == DENSE_LETTER) | (kind == END)
        first = word & ~np.append(False, word[:-1])
        self.start = np.flatnonzero(first | single)
        stop = self.start + 1
        stop[word[self.start]] = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
        self.size = stop - self.start
        self.ends, self.dense = kind[self.start] == END, kind[self.start] == DENSE_LETTER
        self.text = text_of[self.start]
        self.place = np.arange(len(self.start)) - np.searchsorted(self.text, self.text)
        powers, self.inverses = letters.scale(len(codes))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_letter(codes) * powers[: len(codes)])])
        self.hashes = self.prefix(np.arange(len(self.start)), self.size)

    def prefix(self, token: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` letters of tokens."""
        at = self.start[token]
        with np.errstate(over="ignore"):
            return _sealed((self.sums[at + size] - self.sums[at]) * self.inverses[at], size)


def _unfinished(end: str) -> bool:
    """Whether a text with this end, white space taken off, may stop inside a sentence: it
    has no end mark, face, emoji or closing sign there."""
    at = len(end)
    while at and unicodedata.category(end[at - 1])[0] in "MC":  # vowel signs, accents, joiners
        at -= 1
    last, before = end[at - 1 : at], end[: max(at - 1, 0)]
    if not last or end.endswith("\u20e3") or FACE.search(end[:at]):
        return False
    kind = unicodedata.category(last)
    if kind == "Ps":  # it opens even behind an end mark
        return True
    if kind == "Pi" or last in "\"»":
        first = not before or before[-1].isspace() or unicodedata.category(before[-1]) == "Ps"
        # These close, too: a straight quote is the first of a pair, » one that no « came before.
        paired = before.count('"') % 2 == 1 if last == '"' else last == "»" and before.count("»") < before.count("«")
        return first and not paired
    return not CLOSED.search(end) and (last == "’" or last not in CLOSING and kind not in CLOSING_CLASSES)


def _body(text: str) -> tuple[str, bool]:
    """The text without a mark of a cut and white space at its end; whether it had a mark."""
    body = text.rstrip()
    end = body[-40:]  # what the marks look like is short
    m = CUT_MARK.search(end)
    return (body[: len(body) - len(end) + m.start()].rstrip(), True) if m else (body, False)


class Tail:
    """The unfinished end of a text."""

    def __init__(self, text: str):
        body, self.mark = _body(text)
        self.broken = False
        if not self.mark:
            e = BROKEN.search(body[-40:])
            if e:
                self.broken, body = True, body[: max(len(body) - 40, 0) + e.start()]
        self.open = self.broken or _unfinished(body[-200:])
        if not self.open:
            return  # most texts: nothing more is asked of them
        self.tokens = tokens_of(body[-2000:])
        self.open = bool(self.tokens)
        self.few = len(self.tokens) < FEW_WORDS and not any(t in ENDS for t in self.tokens)
        line = body.rsplit("\n", 1)
        #: A last line of a word or two after a closed one, or a word behind a dash: a name.
        self.signed = bool(NAMED.search(body)) or len(line) == 2 and len(line[1].split()) <= 2 and bool(CLOSED.search(line[0].rstrip()) or line[0].rstrip().endswith("--"))
        self.dense = bool(self.tokens) and bool(DENSE_ONE.match(self.tokens[-1]))


def _windows_at(hashes: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Key of the n tokens up to each of some places."""
    key = np.full(len(where), np.uint64(n))
    for back in range(n - 1, -1, -1):
        key = _mix(key, hashes[where - back])
    return key


def _mix_one(a: int, b: int) -> int:
    """``_mix`` of single numbers."""
    x = ((a * int(_M)) & FULL) ^ ((b + (a >> 29)) & FULL)
    x = ((x ^ (x >> 32)) * int(_N)) & FULL
    return x ^ (x >> 29)


def _tail_rows(tail: Tail) -> list[tuple[int, str, int]]:
    """(key, kind, length) of the lookups for one tail."""
    hashes = [_word_hash(t) for t in tail.tokens[-9:]]
    rows = [(reduce(_mix_one, hashes[-n:], n), "window", n) for n in (DENSE_WINDOWS if tail.dense else WINDOWS) if len(hashes) >= n]
    word = tail.tokens[-1]
    if tail.few or tail.signed:
        rows.append((reduce(_mix_one, hashes[-1:], 1), "alone", 1))
    if not tail.dense and len(word) <= LONGEST_PREFIX and re.match(r"\w", word):
        for n in CONTEXTS:
            if len(hashes) > n:
                context = _mix_one(reduce(_mix_one, hashes[-n - 1 : -1], n), AFTER)
                rows += [(_mix_one(context, _word_hash(part)), kind, n) for kind, part in (("prefix", word), ("context", ""))]
    return rows


def _signed64(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64).view(np.int64)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            if not text or not text.strip():
                continue
            tail = Tail(text)
            if not tail.open:
                continue
            for key, kind, n in [(0, "text", 0), *_tail_rows(tail)]:
                ids.append(i)
                rows.append((key, kind, n, len(text), tail.mark, tail.broken, tail.few, tail.signed, len(tail.tokens), _body(text)[0] if kind == "text" else None))
        columns = [batch["doc_id"].take(pa.array(ids, pa.int64())), batch["source"].take(pa.array(ids, pa.int64()))]
        columns.append(pa.array(_signed64(np.array([r[0] for r in rows], np.uint64)), pa.int64()))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string())
        columns += [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "key", "kind", "n", "chars", "mark", "broken", "few", "signed", "n_tokens", "body"])


_TAILS = "doc_id {id}, source string, key long, kind string, n int, chars long, mark boolean, broken boolean, few boolean, signed boolean, n_tokens long, body string"


def _count_windows(mask: np.ndarray):
    """Counts, of all windows and word prefixes that pass the filter, those followed by
    more words (``more``) and by a sentence's end (``ended``)."""
    shift = np.uint64(64 - int(len(mask) * 8).bit_length() + 1)

    def wanted(keys: np.ndarray) -> np.ndarray:
        place = (keys >> shift).astype(np.int64)
        return (mask[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def counted(letters: Letters, texts: list[str], firsts: list[int], brought: list[int]) -> pa.RecordBatch | None:
        t = Tokens(letters, texts)
        if not len(t.start):
            return None
        hashes, ends, dense = t.hashes, t.ends, t.dense
        fresh = t.place >= np.array(brought)[t.text]
        place = t.place + np.array(firsts)[t.text]
        followed = np.append(t.text[1:] == t.text[:-1], False)
        next_ends = np.append(ends[1:], False)
        run = np.cumsum((t.place == 0) | np.append(False, ends[:-1]))
        # A run is told apart by its length only if no end mark closes it.
        closed = np.zeros(run[-1] + 1, bool)
        closed[run[ends]] = True
        marked = closed[run] | (np.bincount(run)[run] <= np.where(dense, LONGEST_DENSE_RUN, LONGEST_RUN))
        # Of tokens brought along from the piece before, only the last one's follower is new.
        told = followed & marked & (fresh | np.append(fresh[1:], False))
        keys, more = [], []

        def looked(where: np.ndarray, n: int) -> np.ndarray:
            """Counts the windows of n tokens that end at these places; which of them are looked for."""
            key = _windows_at(hashes, where, n)
            ok = wanted(key)
            keys.append(key[ok])
            more.append(~next_ends[where[ok]])
            return ok

        looked(np.flatnonzero(told), 1)
        # Who looks for a window looks for its shorter ones, too, down to two tokens or, for
        # dense scripts, to DENSE_WINDOWS: where those are not looked for, no longer one is.
        where = np.flatnonzero(told & (place >= 1))
        for n in sorted(WINDOWS):
            where = where[place[where] >= n - 1]
            where = where[looked(where, n) | dense[where]]
        for n in CONTEXTS:
            # The word at a place, and its prefixes, after the n tokens before it; who looks for
            # a prefix looks for the context alone, too.
            where = np.flatnonzero(fresh & (place >= n) & (t.place >= n))
            context = _mix(_windows_at(hashes, where - 1, n), AFTER)
            ok = wanted(_mix(context, _word_hash("")))
            where, context = where[ok], context[ok]
            size = np.minimum(t.size[where] - 1, LONGEST_PREFIX) + 1
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            key = _mix(np.repeat(context, size), t.prefix(np.repeat(where, size), within))
            ok = wanted(key)
            keys.append(key[ok])
            more.append(np.ones(int(ok.sum()), bool))
        key, goes_on = np.concatenate(keys), np.concatenate(more)
        unique, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, minlength=len(unique))
        going = np.bincount(inverse, weights=goes_on, minlength=len(unique)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(_signed64(unique)), pa.array(going), pa.array(total - going)], names=["key", "more", "ended"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        texts: list[str] = []
        firsts: list[int] = []
        brought: list[int] = []
        held = 0
        for batch in batches:
            for text in batch["text"]:
                for first, before, piece in _pieces(text.as_py() or ""):
                    texts.append(piece)
                    firsts.append(first)
                    brought.append(before)
                    held += len(piece)
                    if held >= LETTERS_AT_ONCE:
                        if (found := counted(letters, texts, firsts, brought)) is not None:
                            yield found
                        texts, firsts, brought, held = [], [], [], 0
        if texts and (found := counted(letters, texts, firsts, brought)) is not None:
            yield found

    return run


def _pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """Place of the first token, how many tokens are from the piece before, and cleaned text.

    A long text comes in pieces cut at blanks (or anywhere, without blanks), each with the
    last tokens of the one before, so that no window is lost at a cut.
    """
    if len(text) <= PIECE:
        if text:
            yield 0, 0, _clean(text)
        return
    at, first, before = 0, 0, []
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = text.rfind(" ", at + PIECE // 2, end)
            end = blank if blank > 0 else end
        found = tokens_of(text[at:end])
        if found:
            yield first - len(before), len(before), " ".join(before + found)
            first += len(found)
            before = (before + found)[-max(WINDOWS) - 1 :]
        at = end


def _filter(asked: DataFrame) -> np.ndarray:
    """A bit per prefix of the hashes in ``key``; at most 2 ** 16 rows of 4 KB come here."""
    bits = int(np.clip(np.ceil(np.log2(max(asked.count(), 1) * FILTER_SHARE)), FEWEST_BITS, MOST_BITS))
    place = F.shiftrightunsigned("key", 64 - bits)
    rows = asked.select(place.alias("place")).groupBy(F.shiftright("place", BLOCK_BITS).alias("block"))
    mask = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << BLOCK_BITS - 3
    for row in rows.agg(F.bitmap_construct_agg(F.col("place") % (1 << BLOCK_BITS)).alias("bits")).toLocalIterator():
        mask[row.block * width : (row.block + 1) * width] = np.frombuffer(bytes(row.bits), np.uint8)
    return mask


def longer_copies(documents: DataFrame, candidates: DataFrame, least: int = COPY_KEY, inside: bool = False) -> DataFrame:
    """``doc_id`` of the candidates whose text goes on in a longer text elsewhere.

    Bodies and texts have ``least`` letters.  If ``inside``, a longer text must go on inside the
    last word, and none may show that word whole.
    """
    kept = documents.where(F.length("text") >= least).select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    asked = kept.join(candidates.select("doc_id"), "doc_id", "left_semi")
    bodies = asked.mapInArrow(_bodies, f"doc_id {kind}, body string").where(F.length("body") >= least)
    return copies_of(kept, bodies).where("within" if inside else "copied").select("doc_id")


def copies_of(documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """``doc_id, copied, within`` of the ``bodies`` (``doc_id, body``: texts without a mark of a cut and
    white space at their end) that a longer text of ``documents`` goes on with.

    ``copied``: some text goes on with words.  ``within``: some goes on inside the last word, and
    none shows that word whole.
    Texts that do not begin like a body are left out first, by a filter of hashed beginnings.
    The others and the bodies, each once, are sorted over all partitions: all texts that
    begin with a body follow it, and any of them decides, so bodies stay open until nothing
    more can be learnt or the texts that begin with them are over.  Bodies open at a
    partition's end, beginnings of its last text all, are held against all texts if the next
    partition goes on with them.
    """
    texts = documents.where("text <> ''").select("text")
    heads = bodies.select(F.least(F.length("body"), F.lit(COPY_KEY)).alias("size"), F.xxhash64(F.substring("body", 1, COPY_KEY)).alias("key")).where("size > 0")
    sizes = [r[0] for r in heads.select("size").distinct().collect()]  # COPY_KEY at most
    near = texts.mapInArrow(_near(_filter(heads), sorted(sizes)), "text string").select("text", F.lit(False).alias("asked"))
    near = near.union(bodies.where("body <> ''").select("body", F.lit(True))).groupBy("text").agg(F.max("asked").alias("asked"))
    parts = documents.sparkSession.sparkContext.defaultParallelism

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, still, seen = TaskContext.get().partitionId(), None, [], {}
        for batch in batches:
            rows = []
            for text, asked in zip(batch["text"].to_pylist(), batch["asked"].to_pylist()):
                if last is None:
                    rows.append(("first", text, 0))
                while still and not text.startswith(still[-1]):
                    still.pop()
                for body in [*still]:
                    for what in _shown(body, text) - seen[body]:
                        rows.append((what, body, 0))
                        seen[body].add(what)
                    if len(seen[body]) == len(SHOWN):
                        still.remove(body)
                if asked:
                    seen = {body: seen[body] for body in still} | {text: set()}
                    still.append(text)
                last = text
            yield _walked(rows, part)
        if last is not None:
            yield _walked([("last", last, 0), *(("open", "", len(body)) for body in still)], part)

    walked = materialise(near.repartitionByRange(parts, "text").sortWithinPartitions("text").mapInArrow(walk, "kind string, part int, text string, size long"), "copies")
    found = walked.where(F.col("kind").isin(*SHOWN)).select("kind", "text")
    crossing = _crossing(walked.where("kind in ('first', 'last', 'open')").collect())  # two texts a partition, and lengths
    if crossing:

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                met = sorted({(what, body) for text in batch["text"].to_pylist() for body in crossing for what in _shown(body, text)})
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], pa.string()) for k in (0, 1)], names=["kind", "text"])

        begin = reduce(lambda x, y: x | y, (F.col("text").startswith(body) for body in crossing))
        found = found.unionByName(texts.where(begin).mapInArrow(held, "kind string, text string"))
    told = {what: F.bool_or(F.col("kind") == what) for what in SHOWN}
    shown = found.groupBy(F.col("text").alias("body")).agg(told["words"].alias("copied"), (told["inside"] & ~told["whole"]).alias("within"))
    return bodies.join(shown, "body").where("copied or within").select("doc_id", "copied", "within")


#: What a text can show of a body: it goes on with words; inside the last word; behind it.
SHOWN = ("words", "inside", "whole")


def _shown(body: str, text: str) -> set[str]:
    if len(text) == len(body) or not text.startswith(body):
        return set()
    inside = body[-1].isalpha() and text[len(body)].isalpha() and not DENSE_ONE.match(body[-1])
    return {"inside" if inside else "whole"} | ({"words"} if _goes_on(body, text) else set())


def _near(mask: np.ndarray, sizes: list[int]):
    """Texts whose first letters, so many as some body has up to COPY_KEY, are in the filter."""
    shift = 64 - int(len(mask) * 8).bit_length() + 1
    bits = mask.tobytes()

    def passes(text: str) -> bool:
        for size in sizes:
            place = xxhash.xxh64_intdigest(text[:size].encode("utf-8", "surrogatepass"), 42) >> shift  # as Spark hashes a string
            if bits[place >> 3] >> (place & 7) & 1:
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(text) for text in batch["text"].to_pylist()], pa.bool_()))

    return run


def _crossing(edges: list) -> list[str]:
    """Bodies open at the end of a partition that the first text of the next begins with."""
    first = {r.part: r.text for r in edges if r.kind == "first"}
    last = {r.part: r.text for r in edges if r.kind == "last"}
    order = sorted(first)
    after = {p: first[q] for p, q in zip(order, order[1:])}
    bodies = {last[r.part][: r.size] for r in edges if r.kind == "open" and after.get(r.part, "").startswith(last[r.part][: r.size])}
    return sorted(bodies)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [_body(text)[0] for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bodies, pa.string())], names=["doc_id", "body"])


def _goes_on(text: str, longer: str) -> bool:
    """Whether a longer text goes on with words; one that only adds an end mark, a name or
    an emoticon shows that the text was whole."""
    if len(longer) == len(text) or not longer.startswith(text):
        return False
    on = GOES_ON.match(longer, len(text)) or unicodedata.category(longer[len(text)])[0] == "M" and longer[len(text)] != "\ufe0f"
    return bool(on) and not SIGNED.match(longer, len(text))


def _walked(rows: list[tuple[str, str, int]], part: int) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.int64())], names=["kind", "part", "text", "size"])


def field_limits(candidates: DataFrame) -> DataFrame:
    """``source, chars, mark`` at which a source's unfinished texts pile up.

    At least LEAST_AT_LIMIT of them have that length, and PEAK times as many as have the
    lengths around it on average.  Texts with a mark of a cut were cut between words, so
    theirs are lengths of a narrow band.
    """
    counted = candidates.groupBy("source", "chars", "mark").agg(F.count("*").alias("n")).where(F.col("chars") >= SHORTEST_LIMIT)
    by = Window.partitionBy("source", "mark").orderBy("chars")
    band = F.when(F.col("mark"), F.sum("n").over(by.rangeBetween(-BAND, BAND))).otherwise(F.col("n"))
    wide = F.when(F.col("mark"), F.sum("n").over(by.rangeBetween(-8 * BAND, 8 * BAND))).otherwise(F.sum("n").over(by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)))
    lengths = F.when(F.col("mark"), (2 * BAND + 1) / (14 * BAND)).otherwise(1 / (2 * NEIGHBOURS))
    peaks = counted.withColumns({"band": band, "others": (wide - band) * lengths}).where((F.col("band") >= LEAST_AT_LIMIT) & (F.col("band") >= PEAK * F.col("others")))
    return peaks.select("source", "chars", "mark")


def truncated_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", title_col: str | None = "title") -> DataFrame:
    """Texts that lack their end: ``doc_id, source, chars, evidence, share``.

    ``source`` is trimmed and lower-cased.  ``evidence`` is ``escape`` (stops inside an escape, a
    tag or a character), ``copy`` (a longer copy goes on), ``limit`` (stops inside a sentence at a
    field limit of its source), ``sentence`` or ``word`` (stops inside one that goes on
    elsewhere); ``share`` is the share of the tail's occurrences elsewhere that end a
    sentence.  A text is no case if it is null or blank, ends on an end mark, an emoticon
    or a closing sign, is a few words only or signed
    with a name (unless a copy goes on inside the last word, or it has the length of a limit), or stands where a
    longer, complete title shows that the two were swapped.  Repeated rows come out as often
    as they occur; the table may be empty.
    """
    title = F.col(title_col).cast("string") if title_col else F.lit(None).cast("string")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), trimmed_lower(F.col(source_col)).alias("source"), title.alias("title"))
    swapped = (F.length("title") > F.length("text")) & F.col("title").rlike("[.!?。！？…]")
    asked = rows.where(~F.coalesce(swapped, F.lit(False))).select("doc_id", "source", "text")
    tails = materialise(asked.mapInArrow(_tails, _TAILS.format(id=rows.schema["doc_id"].dataType.simpleString())), "tails")
    counts = rows.select("text").mapInArrow(_count_windows(_filter(tails.where("kind <> 'text'"))), "key long, more long, ended long").groupBy("key").agg(F.sum("more").alias("more"), F.sum("ended").alias("ended"))
    candidates = tails.where("kind = 'text'").drop("key", "kind", "n", "body")
    looked = tails.where("kind <> 'text'").select("doc_id", "key", "kind", "n").join(counts, "key")

    seen = F.col("more") + F.col("ended")
    # Two words are often a name, which says little; they count if they hardly ever end a sentence.
    enough = (F.col("kind") == "window") & F.when(F.col("n") == 2, (seen >= PAIR_SUPPORT) & (F.col("ended") <= PAIR_SHARE * seen)).otherwise(seen >= SUPPORT)
    judged = looked.groupBy("doc_id").agg(
        F.max_by(F.col("ended") / seen, F.when(enough, F.col("n"))).alias("share"),
        F.max(F.when((F.col("kind") == "window") & (F.col("n") == 2), F.col("more"))).alias("window_2"),
        F.max(F.when(F.col("kind") == "alone", F.col("more"))).alias("alone"),
        *(F.max(F.when((F.col("kind") == kind) & (F.col("n") == n), F.col("more"))).alias(f"{kind}_{n}") for kind in ("prefix", "context") for n in CONTEXTS),
    )
    broken = F.lit(False)
    for n in CONTEXTS:
        common = F.greatest(F.lit(2.0), F.col(f"context_{n}") * RARE)
        broken = broken | F.coalesce(F.col(f"prefix_{n}") >= common, F.lit(False))
    # A last line of a word or two that often begins sentences is one, else it is a name.
    usual = F.coalesce(F.col("window_2") >= F.greatest(F.lit(2.0), F.col("context_1") * RARE), F.lit(False))
    # A few words, or a name, are cut if a copy goes on inside the last word and that is
    # no word elsewhere.
    copies = copies_of(rows, tails.where("kind = 'text'").select("doc_id", "body"))
    limits = field_limits(candidates.where("not few")).withColumn("at_limit", F.lit(True))
    # A text without a source may be from any.
    anywhere = limits.select("chars", "mark", F.lit(True).alias("anywhere")).distinct()
    whole = (
        candidates.join(judged.select("doc_id", "share", "alone", broken.alias("in_word"), usual.alias("usual")), "doc_id", "left").join(copies.distinct(), "doc_id", "left")
        .join(limits, ["source", "chars", "mark"], "left").join(anywhere, ["chars", "mark"], "left")
        .withColumn("at_limit", F.col("at_limit") | (F.col("source").isNull() & F.col("anywhere")))
        .withColumn("copied", F.col("copied") & ~F.col("few"))
        .withColumn("within", F.col("within") & (F.col("few") | F.col("signed")))
    )
    share, none = F.col("share"), F.col("share").isNull()
    in_word = F.coalesce("in_word", F.lit(False)) & none
    likely = F.when(F.col("at_limit") | F.col("copied"), AT_LIMIT).when(F.col("mark"), WITH_MARK).otherwise(OPEN_END)
    evidence = (
        F.when(F.col("broken"), "escape")
        .when(F.col("within") & (F.coalesce("alone", F.lit(0)) < 2), "copy")
        .when(F.col("at_limit") & (F.col("few") | F.col("signed")) & (none | (share <= AT_LIMIT)), "limit")
        .when(F.col("signed") & ~(F.coalesce("usual", F.lit(False)) | in_word), None)
        .when(F.col("few"), None)
        .when(F.col("copied") & (none | (share <= AT_LIMIT)), "copy")
        .when(F.col("at_limit") & (none | (share <= AT_LIMIT)), "limit")
        .when(in_word, "word")
        .when(share <= likely, "sentence")
    )
    return whole.withColumn("evidence", evidence).where("evidence is not null").select("doc_id", "source", "chars", "evidence", "share")


def truncation_report(documents: DataFrame, truncated: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source (trimmed, lower-cased; null stays apart): texts, cut texts and their rate."""
    texts = documents.where("text is not null").groupBy(trimmed_lower(F.col(source_col)).alias("source")).agg(F.count("*").alias("n_texts"))
    cut = truncated.groupBy(F.col("source").alias("cut_source")).agg(F.count("*").alias("n_cut"))
    both = texts.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").fillna(0, ["n_cut"])
    return both.select("source", "n_texts", "n_cut", (F.col("n_cut") / F.col("n_texts")).alias("rate"))

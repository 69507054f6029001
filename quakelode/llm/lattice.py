"""Document likelihood under a unigram model of subwords, summed over all segmentations."""

from __future__ import annotations

import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelode.llm.shared import materialize

HEAD = 150_000  #: words, the most frequent, whose scores every task holds (about 25 MB); others are joined by shuffle
FLUSH = 300_000  #: words that a task counts before it sends them
LONG_BYTES = 80  #: a word of more bytes is never among the most frequent that every task holds
FLUSH_BYTES = 16_000_000  #: of such words that a task counts before it sends them
SPACE = "▁"  #: the mark that begins a word's first piece
_B = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces and the log-probabilities of pieces, of one byte, and of a document's end."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.text = [model.id_to_piece(k) for k in ids]
        # existing scores fall by one a merge: the start is the Zipf law of that rank
        rank = np.array([max(0.0, -model.get_score(k)) if model.get_score(k) > -1e8 else len(ids) for k in ids])
        self.start = 1 / (rank + 10)
        self.longest = max(map(len, self.text))
        h = np.array([self._hash(t) for t in self.text], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.index = {t: k for k, t in enumerate(self.text)}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_B) + ord(c) + 1) & (2**64 - 1)
        return h ^ len(text)

    def first_scores(self) -> np.ndarray:
        """Log-probabilities of the pieces, then of any one byte, then of the end, from the existing scores alone."""
        w = np.concatenate((self.start, [self.start.sum() * 1e-3 , self.start.sum() * 1e-3]))
        out = np.log(w / w.sum())
        out[-2] -= math.log(256)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.order[at], -1)


@lru_cache(2)
def _pieces(path: str | None) -> Pieces:
    return Pieces(path)


def _arcs(pieces: Pieces, codes: np.ndarray, scores: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For words of one length (rows of code points), by end: (begin, piece or -1, log-probability) of the arcs that end there.

    The last arc of each end is one character spelled in bytes; its piece is minus its number of bytes, less one.
    """
    n = codes.shape[1]
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
    with np.errstate(over="ignore"):
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                h = h * _B + codes[:, j - 1] + np.uint64(1)
                k = pieces.find(h ^ np.uint64(j - i))
                if (k >= 0).any():
                    out[j].append((i, k, np.where(k >= 0, scores[k], -np.inf)))
    for j in range(1, n + 1):
        c = codes[:, j - 1]
        width = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
        out[j].append((j - 1, -1 - width, width * scores[-2]))
    return out


def _forward(arcs, n: int, rows: int) -> np.ndarray:
    """Log-probability of each prefix: the log of the sum over the arcs that end there."""
    a = np.full((n + 1, rows), -np.inf)
    a[0] = 0
    for j in range(1, n + 1):
        a[j] = np.logaddexp.reduce([a[i] + s for i, _, s in arcs[j]])
    return a


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the words of each length, with the mark in front, some thousand at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    for block in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        n = int(sizes[block[0]]) + 1
        most = max(1, 400_000 // (n * 8))
        for a in range(0, len(block), most):
            at = block[a : a + most]
            codes = np.frombuffer("".join(SPACE + words[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
            yield at, codes.astype(np.uint64)


def _long_prefixes(pieces: Pieces, text: str, scores: np.ndarray) -> Iterator[float]:
    """The same recursion for one text of any length, keeping as many prefixes as the longest piece needs."""
    a = [0.0]
    yield a[0]
    for j in range(1, len(text) + 1):
        terms = [a[-1] + len(text[j - 1].encode()) * scores[-2]]
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.index.get(text[i:j])
            if k is not None:
                terms.append(a[i - j] + scores[k])
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        yield a[-1]
        if len(a) > pieces.longest + 1:
            a.pop(0)


def _long_word(pieces: Pieces, word: str, scores: np.ndarray) -> float:
    last = 0.0
    for last in _long_prefixes(pieces, SPACE + word, scores):
        pass
    return last


def _long_expected(pieces: Pieces, word: str, weight: float, scores: np.ndarray, out: np.ndarray) -> None:
    """Adds to out what expected_pieces() counts in one word of any length: its prefixes are kept, and suffixes as the longest piece needs."""
    text = SPACE + word
    a = array("d", _long_prefixes(pieces, text, scores))
    b = deque([0.0], pieces.longest)  # of the suffixes from i + 1 on
    for i in range(len(text) - 1, -1, -1):
        width = len(text[i].encode())
        terms = [b[0] + width * scores[-2]]
        out[-1] += weight * width * math.exp(a[i] + terms[0] - a[-1])
        for n in range(1, len(b) + 1):
            k = pieces.index.get(text[i : i + n])
            if k is not None:
                terms.append(b[n - 1] + scores[k])
                out[k] += weight * math.exp(a[i] + terms[-1] - a[-1])
        top = max(terms)
        b.appendleft(top + math.log(sum(math.exp(t - top) for t in terms)))


LONG = 200  #: characters beyond which a word is gone through by itself


def word_scores(words: list[str], scores: np.ndarray, path: str | None = None) -> np.ndarray:
    """Natural log of each word's probability, summed over all its segmentations into pieces and bytes."""
    pieces, out = _pieces(path), np.zeros(len(words))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for at, codes in _by_length([words[k] for k in short]):
        out[np.array(short)[at]] = _forward(_arcs(pieces, codes, scores), codes.shape[1], len(codes))[-1]
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = _long_word(pieces, w, scores)
    return out


def expected_pieces(words: list[str], counts: np.ndarray, scores: np.ndarray, path: str | None = None) -> np.ndarray:
    """How often each piece, and at last a byte, is expected in so many of each word (forward-backward over the lattice)."""
    pieces = _pieces(path)
    out = np.zeros(len(scores) - 1)
    keep = [k for k, w in enumerate(words) if len(w) <= LONG]
    for at, codes in _by_length([words[k] for k in keep]):
        weight, n = counts[np.array(keep)[at]], codes.shape[1]
        arcs = _arcs(pieces, codes, scores)
        a, b = _forward(arcs, n, len(codes)), np.full((n + 1, len(codes)), -np.inf)
        b[n] = 0
        for j in range(n, 0, -1):
            for i, k, s in arcs[j]:
                b[i] = np.logaddexp(b[i], s + b[j])
                post = weight * np.exp(a[i] + s + b[j] - a[n])
                own = k >= 0
                out[:-1] += np.bincount(k[own], post[own], len(out) - 1)
                out[-1] += (post * np.where(k < -1, -1 - k, 0)).sum()
    for k, w in enumerate(words):
        if len(w) > LONG:
            _long_expected(pieces, w, float(counts[k]), scores, out)
    return out


def word_table(documents: DataFrame, text_col: str, learn: str) -> DataFrame:
    """(word, c, seen): counts of each word in the rows to learn from (boolean column ``learn``), and in all rows.

    The null word counts the rows themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
        rows, long_bytes = [0, 0], 0

        def send() -> pa.RecordBatch:
            words = list(counts[0] | counts[1])
            c = [[part[w] for w in words] for part in counts]
            for part in counts:
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(c[1], pa.int64()), pa.array([x + y for x, y in zip(*c, strict=True)], pa.int64())], names=["word", "c", "seen"])

        for batch in batches:
            for text, use in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows[bool(use)] += 1
                found = (text.as_py() or "").encode().lower().split()
                counts[bool(use)].update(found)
                long_bytes += sum(n for n in map(len, found) if n > LONG_BYTES)
                if len(counts[0]) + len(counts[1]) > FLUSH or long_bytes > FLUSH_BYTES:
                    yield send()
                    long_bytes = 0
        yield send()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows[1]], pa.int64()), pa.array([sum(rows)], pa.int64())], names=["word", "c", "seen"])

    part = documents.select(F.col(text_col).cast("string").alias("text"), learn).mapInArrow(run, "word string, c long, seen long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _estimated(words: DataFrame, ends: int, scores: np.ndarray, piece_path: str | None) -> np.ndarray:
    """Scores from how often each piece is expected in the words to learn from, by these scores, which weigh as one token in a thousand."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(scores) - 1)
        for batch in batches:
            out += expected_pieces(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), scores, piece_path)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "x"])

    counts = np.zeros(len(scores))
    for r in words.where("c > 0").select("word", "c").mapInArrow(expect, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        counts[r["at"]] = r["x"]
    counts[-1] = ends
    prior = np.exp(scores)
    prior[-2] *= 256
    counts = counts + prior * max(1.0, 1e-3 * counts.sum())
    out = np.log(counts / counts.sum())
    out[-2] -= math.log(256)
    return out


def likelihoods(documents: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", piece_path: str | None = None, rounds: int = 0) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) for each row of documents.

    Words stand between ASCII white space, A-Z lower-cased; each text has one end after them, which counts as a token.
    score is the log10 probability of the text: the product, over its words, of the sum over all segmentations into the
    vocabulary's pieces (a word's first piece begins with the word mark; any character may also be spelled in bytes),
    times that of the end. Piece probabilities are the vocabulary's existing scores; with rounds, they are estimated
    anew so many times by their expected counts in the words of all rows where ``learn`` holds, the scores before weighing
    as one token in a thousand. base_score is the log10 probability by whole words with c + 0.5 over N + 0.5 (V + 1).

    Null, empty and blank texts are the end alone. Null ids and repeated rows are scored like others; without rows to
    learn from, N and V are 0 (each token is one of one unseen kind, score 0 in the base) and pieces keep their start.

    Words are scored once each, by whoever holds them after the count's shuffle. The most frequent HEAD words go to all
    tasks; a text's other words are joined to their scores by shuffle, after each text has summed its own.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    words = materialize(word_table(rows, "text", "learn"), "lattice-words")
    sums = {r.rows: r for r in words.groupBy(F.col("word").isNull().alias("rows")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()}
    ends = sums[True].n if True in sums else 0
    words = words.where("word is not null")
    total, kinds = ends + (sums[False].n if False in sums else 0), (1 if ends else 0) + (sums[False].v if False in sums else 0)
    scores = _pieces(piece_path).first_scores()
    for _ in range(rounds):
        scores = _estimated(words, ends, scores, piece_path)
    held = spark.sparkContext.broadcast(scores)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = word_scores(batch.column(0).to_pylist(), held.value, piece_path) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=["word", "c", "seen", "p"])

    weighed = materialize(words.mapInArrow(weigh, "word string, c long, seen long, p double"), "lattice-scores")
    # the least count whose words are HEAD at most, from the histogram of counts
    least, room = None, HEAD
    short = F.octet_length("word") <= LONG_BYTES
    for r in weighed.where(short).groupBy(F.least("seen", F.lit(100_000)).alias("seen")).count().orderBy(F.desc("seen")).collect():
        if r["count"] > room:
            break
        least, room = r["seen"], room - r["count"]
    frequent = F.lit(False) if least is None else (F.col("seen") >= least) & short
    top = weighed.where(frequent).select("word", "c", "p").toPandas()
    scale = math.log10(total + 0.5 * (kinds + 1))
    head = spark.sparkContext.broadcast(({w: k for k, w in enumerate(top["word"].str.encode("utf-8"))}, np.log10(top["c"].to_numpy(np.float64) + 0.5) - scale, top["p"].to_numpy(np.float64), top["c"].to_numpy() > 0))
    end = (math.log10(ends + 0.5) - scale, scores[-1] / math.log(10), int(ends > 0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, lattice, known = head.value
        get = index.get
        for batch in batches:
            ids, learned = batch.column(0), batch.column(2)
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                found = (text.as_py() or "").encode().lower().split()
                at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                in_head = at[at >= 0]
                rest = Counter(w for w, k in zip(found, at.tolist(), strict=True) if k < 0)
                for col, value in zip(cols, (len(found) + 1, int(known[in_head].sum()) + end[2], float(base[in_head].sum()) + end[0], float(lattice[in_head].sum()) + end[1], [w.decode() for w in rest], list(rest.values())), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([ids, learned, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True))], names=["id", "learned", "n_tokens", "known", "base", "lattice", "rest", "times"])

    partly = rows.mapInArrow(read, "id long, learned boolean, n_tokens long, known long, base double, lattice double, rest array<string>, times array<long>")
    partly = materialize(partly.withColumn("row", F.monotonically_increasing_id()), "lattice-rows")
    tail = partly.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("k"))
    more = tail.join(weighed.where(~frequent).select("word", "c", "p"), "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - scale)).alias("base2"), F.sum(F.col("k") * F.col("p")).alias("lattice2"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    done = partly.drop("rest", "times").join(more, "row", "left")
    return done.select(F.col("id").alias(id_col), "learned", "n_tokens", plus("known", "known2").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("lattice", "lattice2").alias("score"))

"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces of the product of their probabilities (a forward pass), and that of a text the product over its
words. The piece probabilities are fitted by expectation-maximisation over the word counts of labelled documents; counting
and the expectations run on Spark, and only sums by language and piece, bounded by the vocabulary, reach the driver.

Words are maximal runs of letters in lower case. Their scores are kept per worker, so that a word is scored once however
often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import memory, textops
from ravelin.llm.hashing import KeyTable, Letters
from ravelin.llm.store import written

#: Labelled documents by language that are learned from (about, by a hash of the id); rounds of fitting; words that a worker
#: remembers; weight of the common distribution.
SAMPLE, ROUNDS, MOST_WORDS, PRIOR = 2000, 3, 1 << 21, 500.0
#: Letters of the words that are summed over together, as products; longer ones (in scripts without spaces, whole sentences) are summed
#: over one by one, as logarithms, with the same result.
TOGETHER = 24
#: Probability of a letter that no piece covers.
_UNKNOWN = 1e-9
_START = "▁"

_letters: list[np.ndarray] = []


def vocabulary(path: str) -> dict[str, int]:
    """The pieces of letters of a SentencePiece model, in lower case, and their numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sorted({p.lower() for p in map(model.id_to_piece, range(model.get_piece_size())) if not p.startswith("<") and p})
    return {p: k for k, p in enumerate(p for p in found if all(c == _START or c.isalpha() for c in p))}


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return _letters[0]


def words(column: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, text, starts, ends, word offsets by row, padded bytes of 4 a letter) of the words of runs of rows; null reads as
    empty."""
    letter = _is_letter()
    for first, end, data, offsets in textops.chunks(column):
        text = data.tobytes().decode()
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length in lower case
            parts = [text[a:b].lower() for a, b in zip(at[:-1], at[1:], strict=True)]
            low, at = "".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        own = np.concatenate((letter.take(codes), [False]))
        begin, close = own[:-1].copy(), own[:-1] & ~own[1:]
        begin[1:] &= ~own[:-2]
        heads = at[:-1][at[:-1] < at[1:]]
        begin[heads] = own[heads]
        close[heads[1:] - 1] = own[heads[1:] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
        yield first, end, low, starts, ends, np.searchsorted(starts, at), textops.padded(codes.view(np.uint8))


class Pieces(dict):
    """Numbers of pieces; ``heads`` are the beginnings of longer ones, at which looking further pays."""

    def __init__(self, pieces: dict[str, int]):
        super().__init__(pieces)
        self.heads = {p[:k] for p in pieces for k in range(1, len(p))}

    def __reduce__(self):
        return Pieces, (dict(self),)

    def arcs(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(from, to, piece) of all pieces inside a word, by their beginnings; a letter that is no piece has the number behind the last."""
        unknown, get, heads, n = len(self), self.get, self.heads, len(word)
        for i in range(n):
            own = word[i]
            yield i, i + 1, get(own, unknown)
            j = i + 1
            while j < n and own in heads:
                j += 1
                own = word[i:j]
                p = get(own)
                if p is not None:
                    yield i, j, p


class Lattice:
    """All pieces inside a list of words: arcs (word, from, to, piece), ordered by their end."""

    def __init__(self, found: list[str], pieces: dict[str, int]):
        pieces = pieces if isinstance(pieces, Pieces) else Pieces(pieces)
        arcs: list[tuple[int, int, int, int]] = []
        for w, word in enumerate(found):
            arcs += [(w, *arc) for arc in pieces.arcs(_START + word)]
        table = np.array(arcs, np.int64).reshape(-1, 4)
        table = table[np.argsort(table[:, 2], kind="stable")]
        self.word, self.i, self.j, self.piece = table.T
        self.size = np.array([len(w) + len(_START) for w in found], np.int64)
        self.steps = np.searchsorted(self.j, np.arange(1, (int(self.size.max()) if len(found) else 0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, place, column]: summed probability of all segmentations up to a place, for piece probabilities p[piece, column]."""
        alpha = np.zeros((len(self.size), len(self.steps), p.shape[1]))
        alpha[:, 0] = 1.0
        for j in range(1, len(self.steps)):
            s = slice(self.steps[j - 1], self.steps[j])
            np.add.at(alpha[:, j], self.word[s], alpha[self.word[s], self.i[s]] * p[self.piece[s]])
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of words that occur ``counts`` times, for probabilities p[piece]."""
        alpha = self.forward(p[:, None])[:, :, 0]
        total = alpha[np.arange(len(self.size)), self.size]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.size)), self.size] = 1.0
        for j in range(len(self.steps) - 1, 0, -1):
            s = slice(self.steps[j - 1], self.steps[j])
            np.add.at(beta, (self.word[s], self.i[s]), beta[self.word[s], j] * p[self.piece[s]])
        share = alpha[self.word, self.i] * p[self.piece] * beta[self.word, self.j] / np.maximum(total[self.word], 1e-300)
        return np.bincount(self.piece, share * counts[self.word], minlength=len(p))


def long_forward(word: str, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """The log of the summed probability of all segmentations of one word of any length, for logs[piece, column].

    Sums are carried on to the places where pieces end, so only the places up to the longest piece are held.
    """
    open_: dict[int, list[np.ndarray]] = {0: [np.zeros(logs.shape[1])]}
    now, at = None, -1
    for i, j, p in pieces.arcs(_START + word):
        if i != at:
            at, now = i, np.logaddexp.reduce(open_.pop(i), axis=0)
        open_.setdefault(j, []).append(now + logs[p])
    return np.logaddexp.reduce(open_[len(word) + len(_START)], axis=0)


def long_expected(word: str, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of one word of any length, for logs[piece]."""
    arcs = list(pieces.arcs(_START + word))
    n = len(word) + len(_START)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    for i, j, p in arcs:
        ahead[j] = np.logaddexp(ahead[j], ahead[i] + logs[p])
    for i, j, p in reversed(arcs):
        back[i] = np.logaddexp(back[i], logs[p] + back[j])
    first, last, piece = np.array(arcs).T
    return np.bincount(piece, np.exp(ahead[first] + logs[piece] + back[last] - ahead[n]), minlength=len(logs))


class Scorer:
    """Log probabilities of words under each language, remembered by a worker."""

    def __init__(self, pieces: dict[str, int], p: np.ndarray):
        self.pieces, self.p, self.log_p = Pieces(pieces), p, np.log(np.maximum(p, 1e-300))
        self._clear()

    def _clear(self) -> None:
        self.known, self.letters, self.logs = KeyTable(), Letters(), np.zeros((1 << 15, self.p.shape[1]), np.float32)

    def logs_of(self, found: list[str]) -> np.ndarray:
        out = np.zeros((len(found), self.p.shape[1]))
        short = [k for k, word in enumerate(found) if len(word) <= TOGETHER]
        for k in range(0, len(short), 4096):
            own = short[k : k + 4096]
            lattice = Lattice([found[w] for w in own], self.pieces)
            out[own] = np.log(np.maximum(lattice.forward(self.p)[np.arange(len(own)), lattice.size], 1e-300))
        for k, word in enumerate(found):
            if len(word) > TOGETHER:
                out[k] = long_forward(word, self.pieces, self.log_p)
        return out

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(summed logs by language, number of words) of each text."""
        sums, n = np.zeros((len(column), self.p.shape[1])), np.zeros(len(column), np.int64)
        for first, end, text, starts, ends, at, raw in words(column):
            keys = textops.hashed(raw, 4 * starts, 4 * ends) | np.uint64(1)
            entry = self.known.find(keys)
            if (entry < 0).any():
                new, where = np.unique(keys[entry < 0], return_index=True)
                where = np.flatnonzero(entry < 0)[where]
                if self.known.n + len(new) > MOST_WORDS:
                    self._clear()
                    new, where = np.unique(keys, return_index=True)
                logs = self.logs_of([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                rows = self.known.add(new)
                self.letters.add(raw, 4 * starts[where], 4 * (ends - starts)[where])
                while self.known.n > len(self.logs):
                    self.logs = np.concatenate((self.logs, np.zeros_like(self.logs)))
                self.logs[rows] = logs
                entry = self.known.find(keys)
            n[first:end] = np.diff(at)
            logs = self.logs.take(entry, axis=0)
            # words that have another word's key are scored by themselves
            other = self.letters.differ(entry, raw, 4 * starts, 4 * (ends - starts))
            if len(other):
                logs[other] = self.logs_of([text[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            total = np.concatenate((np.zeros((1, self.p.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)))
            sums[first:end] = total[at[1:]] - total[at[:-1]]
        return sums, n


class Model:
    """Learned languages, pieces and p[piece, language]; the last row is for letters without a piece."""

    def __init__(self, languages: list[str], pieces: dict[str, int], p: np.ndarray):
        import uuid

        self.languages, self.pieces, self.p, self.name = languages, pieces, p, uuid.uuid4().hex

    def scorer(self) -> Scorer:
        return memory.kept(f"scorer:{self.name}", lambda: Scorer(self.pieces, self.p))


def _word_counts(batches):
    for batch in batches:
        for lang in set(batch.column(0).to_pylist()):
            own = batch.filter(pa.array([x == lang for x in batch.column(0).to_pylist()]))
            for _, _, text, starts, ends, _, _ in words(own.column(1)):
                found = Counter(text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])


def _expectations(held):
    def rows(batches):
        languages, pieces, p = held.value
        pieces, logs = Pieces(pieces), np.log(np.maximum(p, 1e-300))
        sums = np.zeros((len(languages), len(pieces) + 1))
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
            found, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for k in range(len(languages)):
                own = np.flatnonzero(lang == k)
                short = [i for i in own.tolist() if len(found[i]) <= TOGETHER]
                for at in range(0, len(short), 2048):
                    part = short[at : at + 2048]
                    sums[k] += Lattice([found[i] for i in part], pieces).expected(p[:, k], n[part].astype(float))
                for i in own.tolist():
                    if len(found[i]) > TOGETHER:
                        sums[k] += n[i] * long_expected(found[i], pieces, logs[:, k])
        k, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[k, piece])], ["k", "piece", "c"])

    return rows


def fit(labelled: DataFrame, path: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of the languages in ``labelled``; rows without a text or language teach nothing.

    About ``sample`` documents of each language are used, picked by a hash of their id, which bounds the work of fitting.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("h")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(sizes), vocabulary(path)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int((1 << 20) * min(1.0, sample / sizes[k])) + 1)])
    counts = written(rows.where(F.col("h") < share[F.col("lang")]).select("lang", "text").mapInArrow(memory.lean(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = _UNKNOWN
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((languages, pieces, p))
        sums = np.zeros((len(languages), len(pieces) + 1))
        for r in counts.mapInArrow(memory.lean(_expectations(held)), "k int, piece int, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).collect():
            sums[r.k, r.piece] = r.c
        sums = sums[:, :-1]
        common = (sums.sum(axis=0) + 0.01) / (sums.sum() + 0.01 * len(pieces))
        p = np.vstack([((sums + PRIOR * common) / (sums.sum(axis=1, keepdims=True) + PRIOR)).T, np.full((1, len(languages)), _UNKNOWN)])
    return Model(languages, pieces, p)


def _predicted(held, at: int, names: list[str], kept: bool):
    """Rows with their language; the text goes back only if it is ``kept``."""

    def rows(batches):
        model = held.value
        for batch in batches:
            sums, n = model.scorer().texts(batch.column(at))
            if model.languages:
                best = sums.argmax(axis=1)
                score = 1.0 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
                lang = [model.languages[b] if c else "und" for b, c in zip(best.tolist(), n.tolist(), strict=True)]
            else:
                lang, score = ["und"] * len(batch), np.zeros(len(batch))
            own = batch if kept else batch.select([c for k, c in enumerate(batch.schema.names) if k != at])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(np.where(n > 0, score, 0.0))], [*own.schema.names, *names])

    return rows


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row and (lang_pred, score): the likeliest learned language of the whole text and its posterior.

    ``names`` are the names of the two new columns; ``keep`` mustn't hold them.

    Null texts and texts without a letter are ``und`` with a score of 0, as is every text if no language was learned. Rows that
    repeat stay rows, ties go to the first language by name, an empty table gives no rows, and other columns are not read.
    """
    held, keep = docs.sparkSession.sparkContext.broadcast(model), list(keep or [])
    # a text that is kept anyway isn't sent twice
    if text_col in keep and dict(docs.dtypes)[text_col] == "string":
        rows, at, more = docs.select(*keep), keep.index(text_col), []
    else:
        more = [memory.free_name([*keep, *names], "text")]
        rows, at = docs.select(*keep, F.col(text_col).cast("string").alias(more[0])), len(keep)
    back = [f for f in rows.schema.fields if f.name not in more]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in back) + f"`{names[0]}` string, `{names[1]}` double"
    return rows.mapInArrow(memory.lean(_predicted(held, at, list(names), not more), keeps=True), schema)


def held_out(id_col: str = "doc_id"):
    """Column: is the document kept from learning? The crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

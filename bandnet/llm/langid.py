"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The likelihood of a word is the sum over all ways to
cut it into pieces, by the forward algorithm; that of a text is the product over its words. Words are scored once and
looked up after that.
"""

from __future__ import annotations

import gc
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name
from bandnet.llm.textbytes import give_back

WORD_START = "▁"
UNKNOWN = 1e-7  # probability of a character that is no piece, alike in all languages
LONG_WORD = 32
RESCALE = 8  # characters after which running values are brought back to about 1
WORD_MEMORY = 500_000
MOST_LANGUAGES = 200
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1342543DE82EF95)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_counts(docs: DataFrame, model: bytes, text: str, lang: str) -> DataFrame:
    """``(lang, piece, n)``: how often the vocabulary's own segmentation of the texts of a language has a piece.

    Counted within partitions first, so the shuffle carries at most the vocabulary for each language and partition.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(known.value)
        size = processor.vocab_size()
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size, dtype=np.int64))
        pending: dict[str, Counter] = defaultdict(Counter)

        def flush(name: str) -> None:
            said = list(pending[name])
            for first in range(0, len(said), 4096):
                part = said[first : first + 4096]
                ids = processor.encode(part, num_threads=1)
                lengths = [len(x) for x in ids]
                weights = np.repeat([pending[name][w] for w in part], lengths)
                totals[name] += np.bincount(np.concatenate([np.array(x, np.int64) for x in ids]), weights, size).astype(np.int64)
            pending[name].clear()

        for batch in batches:
            for said, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pending[name].update(words_of(said))
                if len(pending[name]) > 200_000:
                    flush(name)
        for name in list(pending):
            flush(name)
        for name, counts in totals.items():
            pieces = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(pieces), pa.string()), pa.array(pieces, pa.int32()), pa.array(counts[pieces])], names=["lang", "piece", "n"]
            )

    rows = docs.select(F.col(text).cast("string"), F.col(lang).cast("string"))
    counted = rows.mapInArrow(count, "lang string, piece int, n long")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn_languages(docs: DataFrame, model: bytes, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> dict:
    """Piece probabilities of every language that occurs: from all rows with a text and a language, no sample.

    Only the counts reach the driver: vocabulary times languages, of which there may be ``MOST_LANGUAGES``.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = piece_counts(usable, model, text, lang)
    size = _processor(model).vocab_size()
    table: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():
        if row["lang"] not in table:
            if len(table) == MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            table[row["lang"]] = np.zeros(size)
        table[row["lang"]][row["piece"]] += row["n"]
    names = sorted(table)
    probability = np.array([(table[n] + smoothing) / (table[n].sum() + smoothing * size) for n in names]).reshape(len(names), size)
    return {"languages": names, "probability": probability.T.copy(), "model": model}


class WordScorer:
    """Log-likelihoods of words in every language, by the forward algorithm."""

    def __init__(self, learnt: dict):
        processor = _processor(learnt["model"])
        self.probability = learnt["probability"]
        self.languages = learnt["languages"]
        self.pieces: dict[str, int] = {}
        for i in range(processor.vocab_size()):
            if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)):
                self.pieces.setdefault(processor.id_to_piece(i), i)
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(self.pieces.values()))[order]
        self.likely = np.zeros(1 << 22, dtype=bool)  # whether a hash may be a piece's
        self.likely[self._slot(self.hashes)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_BASE) + ord(c) + 1) % (1 << 64)
        return value

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> np.uint64(42)).astype(np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of the sum over all segmentations of each word with its start mark."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if len(w) <= LONG_WORD:
                by_length[len(w)].append(i)
            else:
                out[i] = self._score_long(WORD_START + w)
        for length, which in by_length.items():
            for first in range(0, len(which), 4096):
                part = which[first : first + 4096]
                joined = "".join(WORD_START + words[i] for i in part)
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), length + 1)
                out[part] = self._forward(codes.astype(np.uint64))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        ahead = np.zeros((length + 1, n, len(self.languages)))
        ahead[0] = 1.0
        shift = np.zeros(ahead.shape[1:])
        for start in range(length):
            if start and start % RESCALE == 0:
                scale = ahead[start].copy()
                ahead[start : start + self.longest] /= scale
                shift += np.log(scale)
            value = np.zeros(n, dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                value = value * _BASE + codes[:, end - 1] + np.uint64(1)
                rows = np.flatnonzero(self.likely[self._slot(value)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.hashes, value[rows]), len(self.hashes) - 1)
                    same = self.hashes[at] == value[rows]
                    rows, ids = rows[same], self.ids[at[same]]
                    ahead[end, rows] += ahead[start, rows] * self.probability[ids]
                if end == start + 1:
                    missing = np.ones(n, dtype=bool)
                    missing[rows] = False
                    ahead[end, missing] += ahead[start, missing] * UNKNOWN
        return np.log(ahead[length]) + shift

    def _score_long(self, word: str) -> np.ndarray:
        """One word of any length, with the running values brought back to about 1 now and then."""
        window = [np.ones(len(self.languages))]  # the values behind the last ``longest`` places
        shift = np.zeros(len(self.languages))
        for end in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for back in range(1, min(self.longest, end) + 1):
                piece = self.pieces.get(word[end - back : end])
                if piece is not None:
                    total += window[-back] * self.probability[piece]
                elif back == 1:
                    total += window[-1] * UNKNOWN
            window = [*window[-self.longest + 1 :], total]
            if end % RESCALE == 0:
                window = [w / total for w in window]
                shift += np.log(total)
        return np.log(window[-1]) + shift


def identify_languages(docs: DataFrame, learnt: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior probability (languages being equally likely beforehand).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no language was learnt. Equal
    posteriors go to the first language by name. Whole texts are scored, long words too; repeated rows are scored
    alike; an empty table gives an empty one; columns named like the new ones are replaced, all others stay.
    """
    docs = docs.drop("lang_pred", "score")
    (found,) = fresh_name(docs, "found")
    known = docs.sparkSession.sparkContext.broadcast(learnt)

    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()  # the dictionary of words has no cycles to look for
        learnt = known.value
        names = learnt["languages"]
        # A Python worker serves many tasks; what it has scored stays with the process
        kept = sys.modules.setdefault("bandnet_worker_memory", ModuleType("bandnet_worker_memory")).__dict__
        name = f"languages-{zlib.crc32(learnt['probability'].tobytes())}-{names}"
        if name not in kept:
            for old in [k for k in kept if k.startswith("languages-")]:
                del kept[old]
            kept[name] = (WordScorer(learnt), {}, np.zeros((0, len(names) + 1)))
        scorer, rows, scores = kept[name]
        for column in columns:
            labels, values = [], []
            texts = column.to_pylist()
            for first in range(0, len(texts), 512):
                split = [words_of(t) for t in texts[first : first + 512]]
                new = list(set().union(*split).difference(rows))
                if len(rows) + len(new) > WORD_MEMORY:
                    rows.clear()
                    scores = scores[:0]
                    new = list(set().union(*split))
                if new and names:
                    letters = np.array([any(map(str.isalpha, w)) for w in new], dtype=float)
                    rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
                    scores = np.concatenate([scores, np.column_stack([scorer.score(new), letters])])
                for words in split:
                    total = scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].sum(axis=0) if words and names else [0.0]
                    if not total[-1]:
                        labels.append("und")
                        values.append(0.0)
                        continue
                    best = int(np.argmax(total[:-1]))
                    labels.append(names[best])
                    values.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            kept[name] = (scorer, rows, scores)
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(values, pa.float64())], names=["lang_pred", "score"])
        give_back()

    identify.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(identify, "lang_pred string, score double").asNondeterministic()
    out = docs.withColumn(found, udf(F.col(text).cast("string")))
    return out.select(*docs.columns, F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))

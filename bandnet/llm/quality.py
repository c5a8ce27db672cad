"""Quality rules: counting rules on words, then a linear-chain conditional random field over lines.

The field labels every line content or boilerplate; the share of characters in content lines decides. It is fitted here on
labelled documents, whose label is evidence for their lines and not the label of each, and decoded by Viterbi, so that a
page of prose under a menu comes out as both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name
from bandnet.llm.textbytes import WHITE, byte_table, column_bytes, give_back, keyed, run_hashes, runs, slices, windows

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER, LOWER, DIGIT = byte_table((65, 90)), byte_table((97, 122)), byte_table((48, 57))
STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
FEATURES = [
    "bias", "upper", "digits", "symbols", "bars", "no_stop", "exclaims", "long_words", "short_line",
    "one_word", "repeated", "links",
]
BOILERPLATE, CONTENT = 0, 1


class LineModel:
    """Weights of the field: ``emit`` (2, features) and ``step`` (2, 2), label before by label after."""

    def __init__(self, emit, step):
        self.emit, self.step = np.asarray(emit, dtype=float), np.asarray(step, dtype=float)

    def as_lists(self) -> dict[str, list]:
        return {"emit": self.emit.tolist(), "step": self.step.tolist()}


#: With no labelled document at hand every line counts as content
NEUTRAL = LineModel(np.vstack([np.zeros(len(FEATURES)), [1.0] + [0.0] * (len(FEATURES) - 1)]), np.zeros((2, 2)))


def viterbi(scores: np.ndarray, step: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best label of every line; sequences are the stretches between bounds. Ties go to content.

    All sequences that still have a line move on together.
    """
    n = len(scores)
    labels = np.full(n, CONTENT, dtype=np.int8)
    lengths = np.diff(bounds)
    alive = np.flatnonzero(lengths > 0)
    best = np.zeros((n, 2))
    back = np.zeros((n, 2), dtype=np.int8)
    order = alive[np.argsort(-lengths[alive], kind="stable")]
    firsts, ordered = bounds[:-1][order], lengths[order]
    best[firsts] = scores[firsts]
    position, active = 1, len(order)
    while True:
        active = int(np.searchsorted(-ordered, -position, side="left"))  # sequences longer than position
        if not active:
            break
        now = firsts[:active] + position
        options = best[now - 1][:, :, None] + step[None]
        back[now] = np.where(options[:, CONTENT] >= options[:, BOILERPLATE], CONTENT, BOILERPLATE)
        best[now] = options.max(axis=1) + scores[now]
        position += 1
    ends = firsts + ordered - 1
    labels[ends] = np.where(best[ends, CONTENT] >= best[ends, BOILERPLATE], CONTENT, BOILERPLATE)
    for position in range(int(ordered[0]) - 1 if len(ordered) else 0, 0, -1):
        active = int(np.searchsorted(-ordered, -position, side="left"))
        now = firsts[:active] + position
        labels[now - 1] = back[now, labels[now]]
    return labels


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(odds) for _, odds in sequences)
    x = np.zeros((len(sequences), longest, len(FEATURES)))
    known = np.zeros((len(sequences), longest))
    here = np.zeros((len(sequences), longest), dtype=bool)
    for i, (features, odds) in enumerate(sequences):
        x[i, : len(odds)], known[i, : len(odds)], here[i, : len(odds)] = features, odds, True
    return x, known, here


def _expected(x: np.ndarray, here: np.ndarray, emit: np.ndarray, step: np.ndarray, odds: np.ndarray | float = 0.0):
    """Expected sums of features by label and of steps between labels, by forward-backward.

    ``odds`` are log-odds of content that evidence from outside the field adds to a line.
    """
    longest, both = x.shape[1], here[:, 1:] & here[:, :-1]
    score = x @ emit.T
    score[..., CONTENT] += odds
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, longest):
        new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + score[:, t]
        ahead[:, t] = np.where(here[:, t, None], new, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp.reduce(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(here[:, t + 1, None], new, 0)
    norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
    one = np.exp(ahead + behind - norm[:, None, None]) * here[..., None]
    pair = ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[:, None, None, None]
    return np.einsum("stk,stf->kf", one, x), np.exp(np.where(both[..., None, None], pair, -np.inf)).sum((0, 1))


def fit_line_model(sequences: list[tuple[np.ndarray, np.ndarray]], **options) -> LineModel:
    """Weights from (features, labels) sequences: labels that are known are evidence beyond doubt."""
    return fit_hidden_lines([(x, np.where(np.asarray(y) == CONTENT, 1.0, -1.0) * CERTAIN) for x, y in sequences], **options)


#: Log-odds that leave no other label
CERTAIN = 60.0


def fit_hidden_lines(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> LineModel:
    """Weights of a field whose line labels are hidden, from (features, log-odds of content) sequences.

    Expectation and gradient steps in turn: forward-backward with the evidence says how likely each line is content, and
    the weights move to where the field expects as much without it. A line may so get another label than its document's
    evidence says, if lines like it elsewhere do. Without evidence of both kinds, the neutral model.
    """
    sequences = [s for s in sequences if len(s[1])]
    if not sequences or not any((o > 0).any() for _, o in sequences) or not any((o < 0).any() for _, o in sequences):
        return NEUTRAL
    groups: list[list] = []
    for one in sorted(sequences, key=lambda s: len(s[1])):  # alike in length, so that padding at most doubles a sequence
        if not groups or len(one[1]) > 2 * len(groups[-1][0][1]):
            groups.append([])
        groups[-1].append(one)
    padded = [_padded(g) for g in groups]
    emit, step, total = np.zeros((2, len(FEATURES))), np.zeros((2, 2)), sum(here.sum() for _, _, here in padded)
    square_emit, square_step = np.full_like(emit, 1e-8), np.full_like(step, 1e-8)
    for _ in range(rounds):
        told = [_expected(x, here, emit, step, odds) for x, odds, here in padded]
        hoped = [_expected(x, here, emit, step) for x, _, here in padded]
        slope_emit = (sum(e for e, _ in told) - sum(e for e, _ in hoped)) / total - ridge * emit
        slope_step = (sum(s for _, s in told) - sum(s for _, s in hoped)) / total - ridge * step
        square_emit += slope_emit**2
        square_step += slope_step**2
        emit, step = emit + rate * slope_emit / np.sqrt(square_emit), step + rate * slope_step / np.sqrt(square_step)
    return LineModel(emit, step)


class Measured:
    """Counts of every row of a slice, and features of every line that has a word."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        rows = len(cuts) - 1
        word_start, word_end = runs(~WHITE[data], cuts)
        bounds = np.searchsorted(word_start, cuts)
        self.n_words = np.diff(bounds)
        begun = (data & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(begun & ~WHITE[data])])
        self.word_chars = np.diff(points[cuts])
        self.n_symbols = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[cuts])
        words = run_hashes(data, word_start, word_end)
        self.n_repeat_words = self._repeats(words, bounds, 5)

        line_start, line_end = runs(data != 10, cuts)
        words_before = np.searchsorted(word_start, np.concatenate([line_start, line_end])).reshape(2, -1)
        in_line = words_before[1] - words_before[0]
        full = in_line > 0
        line_start, line_end, in_line = line_start[full], line_end[full], in_line[full]
        self.lines = np.searchsorted(line_start, cuts)
        line_row = np.repeat(np.arange(rows), np.diff(self.lines))
        self.line_hash = line_hash = run_hashes(data, line_start, line_end)
        order = np.lexsort((np.arange(len(line_hash)), line_hash, line_row))
        again = np.zeros(len(line_hash), dtype=bool)
        if len(order):
            same = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
            again[order[1:][same]] = True
        self.n_dup_lines = np.bincount(line_row[again], minlength=rows)

        def per_line(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[line_end] - sums[line_start]

        solid = points[line_end] - points[line_start]
        self.line_chars = solid
        upper, lower = per_line(UPPER[data]), per_line(LOWER[data])
        last_word = np.searchsorted(word_start, line_end) - 1
        last_byte = data[word_end[last_word] - 1] if len(last_word) else np.empty(0, np.uint8)
        mean_word = solid / np.maximum(in_line, 1)
        self.features = np.stack([
            np.ones(len(solid)),
            upper / np.maximum(upper + lower, 1),
            per_line(DIGIT[data]) / np.maximum(solid, 1),
            np.minimum(1, 4 * per_line(SYMBOLS[data]) / np.maximum(solid, 1)),
            np.minimum(1, 3 * per_line(data == ord("|")) / np.maximum(in_line, 1)),
            ~STOPS[last_byte],
            np.minimum(1, per_line(data == ord("!")) / np.maximum(in_line, 1)),
            np.minimum(1, np.maximum(0, mean_word - 8) / 8),
            in_line < 8,
            in_line == 1,
            again,
            np.minimum(1, per_line(data == ord("/")) / np.maximum(in_line, 1)),
        ], axis=1).astype(float)

    @staticmethod
    def _repeats(words: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
        """Words inside windows of ``width`` words that their row holds twice or more."""
        found, starts = windows(words, bounds, width)
        row = np.searchsorted(bounds, starts, side="right") - 1
        found = keyed(found, 0) ^ keyed(row.astype(np.uint64), 7)  # of one row only
        order = np.argsort(found)
        same = found[order][1:] == found[order][:-1]
        twice = np.zeros(len(found), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, starts[twice], 1)
        np.add.at(change, starts[twice] + width, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        return np.diff(covered[bounds])


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_content_lines long, content_share double, kept boolean, line_labels string"
)


def _measurer(model: dict[str, list], min_share: float) -> Callable:
    def measure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = LineModel(**model)
        for column in columns:
            data, cuts = column_bytes(column)
            parts: list[list] = []
            for a, b in slices(cuts):
                m = Measured(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                label = viterbi(m.features @ field.emit.T, field.step, m.lines)
                content = np.concatenate([[0], np.cumsum(m.line_chars * (label == CONTENT))])[m.lines]
                share = np.diff(content) / np.maximum(m.word_chars, 1)
                failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
                letters = np.frombuffer(b"BC", dtype=np.uint8)[label].tobytes().decode()
                parts.append([
                    m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, np.diff(m.lines),
                    np.diff(np.concatenate([[0], np.cumsum(label == CONTENT)])[m.lines]), share, ~failed & (share >= min_share),
                    np.array([letters[i:j] for i, j in zip(m.lines[:-1], m.lines[1:], strict=True)], dtype=object),
                ])
            names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
            merged = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(names))]
            yield pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(merged, kinds, strict=True)], names=names)
        give_back()

    measure.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return measure


#: Log-odds of content that a document's label, and a line that stands in many documents, add to a line
LABEL_ODDS, REPEAT_ODDS = 1.0, -2.0
#: A line stands in many documents if so many of the sample, and this share of it, have it
MANY, MANY_SHARE = 3, 0.005


def _line_evidence(max_lines: int):
    """``(k, y, t)`` to ``(k, y, n, features, hashes)``: lines of the sampled documents, measured where they are read."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cuts = column_bytes(batch.column("t"))
            counts, features, hashes = [], [], []
            for a, b in slices(cuts):
                m = Measured(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                for i, j in zip(m.lines[:-1].tolist(), m.lines[1:].tolist(), strict=True):
                    fits = j - i <= max_lines
                    counts.append(j - i if fits else 0)
                    features.append(m.features[i:j].astype(np.float32).tobytes() if fits else b"")
                    hashes.append(m.line_hash[i:j].tobytes() if fits else b"")
            arrays = [batch.column("k"), batch.column("y"), pa.array(counts, pa.int64()), pa.array(features, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "y", "n", "features", "hashes"])
        give_back()

    return measure


def fit_from_labels(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality", max_docs: int = 2000, max_lines: int = 200_000
) -> LineModel:
    """Fit the field on labelled documents: at most ``max_docs``, those with the smallest hash of their key, and ``max_lines`` lines.

    Labels say little of single lines, so the lines' labels are hidden: a line of a document labelled 1 leans to content,
    one of a document labelled 0 or one that many documents of the sample have leans to boilerplate, and ``fit_hidden_lines``
    finds which lines go together. Other labels, null keys and null texts are left out, and so is a document that would
    exceed the bound on lines. The bounds are on the sample for fitting only. Lines are measured on the executors; only
    their features reach the driver. No usable label gives the neutral model.
    """
    marked = labels.where(F.col(good).isin(0, 1)).select(F.col(key).alias("k"), F.col(good).cast("int").alias("y"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    sample = marked.dropna().dropDuplicates(["k"]).orderBy(F.xxhash64("k"), "k").limit(max_docs)
    met = texts.join(F.broadcast(sample), "k").select("k", "y", "t")
    kind = met.schema["k"].dataType.simpleString()
    lines = met.mapInArrow(_line_evidence(max_lines), f"k {kind}, y int, n long, features binary, hashes binary")
    kept, total = [], 0
    for row in lines.where("n > 0").orderBy(F.xxhash64("k"), "k", "hashes").limit(max_docs).toLocalIterator():
        if total + row["n"] <= max_lines:
            total += row["n"]
            features = np.frombuffer(row["features"], dtype=np.float32).reshape(-1, len(FEATURES))
            kept.append((features, row["y"], np.frombuffer(row["hashes"], dtype=np.uint64)))
    if not kept:
        return NEUTRAL
    # In how many documents of the sample each line stands
    once = [np.unique(h) for _, _, h in kept]
    known, often = np.unique(np.concatenate(once), return_counts=True)
    known = known[often >= max(MANY, MANY_SHARE * len(kept))]
    return fit_hidden_lines([
        (features.astype(float), np.where(y == 1, LABEL_ODDS, -LABEL_ODDS) + REPEAT_ODDS * np.isin(h, known)) for features, y, h in kept
    ])


def apply_quality_rules(docs: DataFrame, model: LineModel = NEUTRAL, text: str = "text", min_share: float = 0.5) -> DataFrame:
    """Add the counts, the decoded labels of the lines with words (``C`` or ``B`` each) and the verdict.

    ``base_failed``: fewer than 10 words, or over a fifth of them in repeated windows of five words. ``kept``: not
    failed, and at least ``min_share`` of the characters in words stand in lines that the field calls content. Null
    and empty texts have no words and fail; a single long line is one item; repeated documents are judged alike; an
    empty table gives an empty one. Columns named like the new ones are replaced, all others stay.
    """
    names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
    docs = docs.drop(*names)
    (found,) = fresh_name(docs, "found")
    udf = F.arrow_udf(_measurer(model.as_lists(), min_share), RESULT).asNondeterministic()
    out = docs.withColumn(found, udf(F.col(text).cast("string")))
    return out.select(*docs.columns, *[F.col(f"{found}.{n}").alias(n) for n in names])

"""Language identification by a byte convolutional network, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import held_out

#: Bytes of a window; a text is as many windows as it takes, the last filled with blanks.
WINDOW = 256
#: Numbers that stand for a byte, filters of each width, and the widths.
EMBEDDED, FILTERS, WIDTHS = 8, 16, (2, 3, 4)
#: Windows that go through the network at once.
AT_ONCE = 64
#: Windows that one training document gives at most, evenly spread over its text.
WINDOWS_PER_DOC = 6

#: A-Z to a-z; what is neither an ASCII letter nor part of a longer character is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class ByteCnn:
    """Embedding, convolutions of several widths, the greatest value of each filter over a window, softmax."""

    langs: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    _tables: list[tuple[np.ndarray, np.ndarray | None]] = field(default_factory=list, repr=False)

    @classmethod
    def fresh(cls, langs: list[str], seed: int) -> ByteCnn:
        rng, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        filters = [rng.normal(0, (2 / (w * EMBEDDED)) ** 0.5, (w * EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(langs, rng.normal(0, 1, (256, EMBEDDED)).astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": []}

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """What each pair of bytes adds to the filters at their first two places, and what the next byte or pair adds."""
        if not self._tables:
            for w, f in zip(WIDTHS, self.filters, strict=True):
                at = [self.embedding @ f[i * EMBEDDED : (i + 1) * EMBEDDED] for i in range(w)]
                pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
                self._tables.append((pair(at[0], at[1]), at[2] if w == 3 else pair(at[2], at[3]) if w == 4 else None))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: uint8, a row a window of folded bytes."""
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        pooled = []
        for w, (first, second) in zip(WIDTHS, self.tables(), strict=True):
            n = WINDOW - w + 1
            got = np.take(first, pairs[:, :n], axis=0)
            if second is not None:
                got += np.take(second, windows[:, 2:] if w == 3 else pairs[:, 2:], axis=0)
            pooled.append(got.max(1))
        logits = np.maximum(np.concatenate(pooled, 1) + self.biases, 0) @ self.dense + self.offset
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def step(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """The gradients of the mean cross entropy, in the order of parameters()."""
        rows, codes = np.arange(len(windows))[:, None], self.embedding[windows]
        pooled, wheres = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            cut = np.lib.stride_tricks.sliding_window_view(codes, w, axis=1).transpose(0, 1, 3, 2).reshape(len(windows), -1, w * EMBEDDED)
            got = cut @ f
            wheres.append(got.argmax(1))
            pooled.append(got.max(1))
        hidden = np.concatenate(pooled, 1) + self.biases
        active = np.maximum(hidden, 0)
        logits = active @ self.dense + self.offset
        e = np.exp(logits - logits.max(1, keepdims=True))
        wrong = e / e.sum(1, keepdims=True)
        wrong[rows[:, 0], labels] -= 1
        wrong /= len(windows)
        back = (wrong @ self.dense.T) * (hidden > 0)
        d_embedding, d_filters = np.zeros_like(self.embedding), []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            places = wheres[k][:, :, None] + np.arange(w)
            seen = windows[rows[:, :, None], places]  # (window, filter, place)
            vectors = self.embedding[seen].reshape(len(windows), FILTERS, -1)
            d_filters.append(np.einsum("nf,nfd->df", own, vectors))
            into = (own[:, :, None] * f.T[None]).reshape(len(windows), FILTERS, w, EMBEDDED)
            np.add.at(d_embedding, seen, into)
        return [d_embedding, *d_filters, back.sum(0), active.T @ wrong, wrong.sum(0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.biases, self.dense, self.offset]


def windows_of(text: bytes) -> np.ndarray:
    """A text's folded windows, all of them; blanks fill the last."""
    folded = text.translate(FOLD)
    return np.frombuffer(folded.ljust(-(-len(folded) // WINDOW) * WINDOW), np.uint8).reshape(-1, WINDOW)


def fit(samples: list[tuple[str, bytes]], steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 7) -> ByteCnn | None:
    """A network trained by Adam on (lang, piece of text); None where there is no sample."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng, net = np.random.default_rng(seed), ByteCnn.fresh(langs, seed)
    pieces = [windows_of(text[:WINDOW] or b" ")[0] for _, text in samples]
    data, labels = np.stack(pieces), np.array([langs.index(lang) for lang, _ in samples])
    by_lang = [np.flatnonzero(labels == i) for i in range(len(langs))]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for t in range(1, steps + 1):
        # Languages are drawn alike, however many samples they have; half of the windows are cut short, as short texts are.
        rows = np.array([rng.choice(by_lang[i]) for i in rng.integers(0, len(langs), batch)])
        x = data[rows].copy()
        for i in np.flatnonzero(rng.random(batch) < 0.5):
            x[i, rng.integers(8, WINDOW) :] = 32
        for p, g, m, v in zip(net.parameters(), net.step(x, labels[rows]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * min(1, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, rows: int = 3_000, seed: int = 7) -> ByteCnn | None:
    """Fit a network to a bounded sample of docs (doc_id, text, lang), without held-out rows.

    About rows documents are taken in all, as many from each language as it has or its even share, by hashes of their
    text; each gives at most WINDOWS_PER_DOC windows, spread evenly over the whole of its text. Rows without text,
    letter or lang teach nothing.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return None
    share = max(1, rows // len(counts))
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_003)) / 1_000_003.0
    pieces = F.expr(f"transform(sequence(0, cast(least({WINDOWS_PER_DOC}, ceil(length(text) / {WINDOW}.0)) as int) - 1), i -> substring(text, 1 + cast(floor(i * (length(text) / least({WINDOWS_PER_DOC}.0D, ceil(length(text) / {WINDOW}.0)))) as int), {WINDOW}))")
    sample = usable.filter(drawn < chance).distinct().select("lang", F.explode(pieces).alias("piece")).collect()
    return fit(sorted((r["lang"], r["piece"].encode()) for r in sample if any(map(str.isalpha, r["piece"]))), seed=seed)


def _identified(net: ByteCnn | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = ["und"] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            held: list[tuple[int, np.ndarray]] = []
            sums = np.zeros((batch.num_rows, len(net.langs) if net else 0))

            def flush() -> None:
                if not held:
                    return
                rows = np.repeat([i for i, _ in held], [len(w) for _, w in held])  # noqa: B023
                windows = np.concatenate([w for _, w in held])  # noqa: B023
                for at in range(0, len(windows), AT_ONCE):
                    own = windows[at : at + AT_ONCE]
                    weight = (own != 32).sum(1)[:, None]
                    np.add.at(sums, rows[at : at + AT_ONCE], net.probabilities(own) * weight)  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if net is None or text is None or not any(map(str.isalpha, text)):
                    continue
                held.append((i, windows_of(text.encode("utf-8", "surrogatepass"))))
                size += len(held[-1][1])
                if size >= 16 * AT_ONCE:
                    flush()
                    size = 0
            flush()
            for i in np.flatnonzero(sums.sum(1) > 0):
                best = int(sums[i].argmax())
                langs[i], scores[i] = net.langs[best], sums[i, best] / sums[i].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """The language of each whole text: every window is classified, and windows count by their letters.

    docs: doc_id, text; other columns are ignored, lang among them. Null texts and texts without a letter are `und`
    with score 0, as is everything without a network. Rows that repeat come out as often; an empty table gives no rows.
    Returns doc_id, lang_pred, score (the mean probability of lang_pred).
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_identified(net), "doc_id long, lang_pred string, score double")


def _labelled(net: ByteCnn | None, at: int):
    """As _identified, with all columns kept: two more behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
            for found in _identified(net)(iter([two])):
                yield pa.RecordBatch.from_arrays([*batch.columns, found.column(1), found.column(2)], [*map(str, range(batch.num_columns)), "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, net: ByteCnn | None, least: float = 0.4) -> DataFrame:
    """docs without what has no language: texts that are `und` or whose language is less likely than least go.

    A kept row's lang, where docs has that column, is the language found. No row is shuffled.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{n} {k}" for n, k in plain.dtypes)
    found = plain.mapInArrow(_labelled(net, docs.columns.index("text")), f"{kinds}, lang_pred string, score double")
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[(F.col("lang_pred") if c == "lang" else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

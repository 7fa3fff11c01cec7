"""Prediction by partial matching over a byte-context trie.

A text is the sequence of its words (ASCII letters lower-cased), each closed by one
separator byte, and one end symbol; contexts reach across words. The trie holds, for
every context of up to ``ORDER`` bytes, how often each next symbol followed it in the
training texts. A symbol unseen in the longest context escapes to the next shorter
one (method D: of n occurrences of q symbols the escape gets q / 2n, a symbol seen c
times (2c - 1) / 2n), and symbols of the longer context are excluded below; below
order 0 the rest of the alphabet shares equally. So the probabilities of all next
symbols sum to one in every context.

Over a corpus the trie is a table of windows (a context and its symbol). Chunks of
documents list their distinct windows and words with training counts, which meet by
key in a shuffle that grows with the corpus. Contexts of two bytes and less make a
table that the alphabet bounds; each window takes its row of that from a join, and
gets its log-probability beside the others that share its last three context bytes.
The values go back to the chunks that asked, and there the texts stream past them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import default_partitions, discard, held_out, placed, stored

ORDER = 5
PAD, SEP, END = 0x09, 0x20, 0x0A  # none of them occurs inside a word
ALPHABET = 256 - 6 + 2  # bytes of words, the separator, the end
#: Rows go to one chunk until their texts have so many characters; chunks bound memory and change no result.
CHUNK_CHARS = 24_000_000
#: Windows are sorted and looked up by so many at a time.
SLICE = 1 << 20
_ROWS = 50_000  # of an outgoing batch
_HEAD = bytes([PAD] * (ORDER - 1) + [SEP])


class ByteTrie:
    """The model in its plain form, one update or lookup at a time.

    Used for adaptive scoring of single documents and as the brute-force version of
    the corpus-wide computation.
    """

    def __init__(self) -> None:
        self.nodes: dict[bytes, Counter] = defaultdict(Counter)

    @staticmethod
    def steps(words):
        """(context, symbol) of every symbol of a text."""
        text = spelled(words)
        for i in range(ORDER, len(text)):
            yield text[i - ORDER : i], text[i]

    def add(self, context: bytes, symbol: int, n: int = 1) -> None:
        for k in range(ORDER + 1):
            self.nodes[context[ORDER - k :]][symbol] += n

    def log10(self, context: bytes, symbol: int) -> float:
        total, excluded = 0.0, frozenset()
        for k in range(ORDER, -1, -1):
            seen = self.nodes.get(context[ORDER - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            size = 2 * sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / size)
            total += math.log10(len(left) / size)
            excluded = frozenset(seen)
        return total - math.log10(ALPHABET - len(excluded))

    def score(self, words, adapt: bool = False) -> float:
        total = 0.0
        for context, symbol in self.steps(words):
            total += self.log10(context, symbol)
            if adapt:
                self.add(context, symbol)
        return total


def words_of(raw: bytes) -> list[bytes]:
    """bytes.lower touches A-Z only and bytes.split cuts at [\\x20\\x09-\\x0D]+."""
    return raw.lower().split()


def spelled(words: list[bytes]) -> bytes:
    """The first symbol's context, each word with its separator, the end."""
    return _HEAD + b" ".join([*words, b"\n"])


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adaptive code length: every document starts from an empty trie and learns as it goes.

    Returns id, n_symbols and bits. A null text counts as empty. Documents are
    independent, so this is one pass without a shuffle.
    """

    def run(batches):
        for batch in batches:
            symbols, bits = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                symbols.append(sum(map(len, words)) + len(words) + 1)
                bits.append(-ByteTrie().score(words, adapt=True) / math.log10(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(symbols, pa.int64()), pa.array(bits, pa.float64())], ["id", "n_symbols", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_symbols long, bits double")
    return out.withColumnRenamed("id", id_col)


def slices(texts):
    """From spelled texts: (first row, rows, sorted windows with the row's place in the low 16 bits).

    A window is packed with the last context byte highest and the symbol lowest. A
    slice holds whole texts up to SLICE bytes; a longer text is spread over slices of
    its own, which begin inside the one before by a context.
    """
    first, parts, size = 0, [], 0
    for row, text in enumerate(texts):
        if parts and (size + len(text) > SLICE or row - first >= 1 << 16):
            yield first, len(parts), _packed(parts)
            parts, size = [], 0
        if not parts:
            first = row
        if len(text) > SLICE:
            for at in range(0, len(text) - ORDER, SLICE):
                yield row, 1, _packed([text[at : at + SLICE + ORDER]])
            continue
        parts.append(text)
        size += len(text)
    if parts:
        yield first, len(parts), _packed(parts)


def _packed(parts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    keys = data[ORDER:].copy()
    for k in range(1, ORDER + 1):
        keys |= data[ORDER - k : len(data) - k] << np.uint64(8 * (ORDER - k + 1))
    row = np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)[ORDER:]
    inside = np.ones(len(keys), bool)  # the first ORDER bytes of a part are context alone
    starts = np.cumsum(lengths)[:-1] - ORDER
    inside[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    out = (keys << np.uint64(16) | row)[inside]
    out.sort()
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(weights[order], first)


class _Chunk:
    """Words and windows of one chunk with their counts in training texts."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.whole = 0  # windows in the first of parts, which is merged

    def add(self, raws: list[bytes | None], held: list[bool]) -> None:
        split = [words_of(raw or b"") for raw in raws]
        for words, out in zip(split, held, strict=True):
            if out:
                for w in words:
                    self.words.setdefault(w, 0)
                self.words.setdefault(b"\n", 0)
            else:
                self.words.update(words)
                self.words[b"\n"] += 1
        train = ~np.array(held)
        for first, rows, packed in slices(map(spelled, split)):
            keys = packed >> np.uint64(16)
            begin = _runs(keys)
            n = np.add.reduceat(train[first : first + rows][(packed & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64), begin)
            self.parts.append((keys[begin].view(np.int64), n))
            if sum(len(k) for k, _ in self.parts[1:]) > max(self.whole, SLICE):
                self.merge()

    def merge(self) -> None:
        self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.whole = len(self.parts[0][0])

    def rows(self, label: int):
        self.merge()
        keys, n = self.parts[0]
        words = sorted(self.words)
        for at in range(0, len(keys), _ROWS):
            part = keys[at : at + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), label), pa.int64()), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[at : at + _ROWS])], ["chunk", "word", "win", "n"])
        for at in range(0, len(words), _ROWS):
            part = words[at : at + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), label), pa.int64()), pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([self.words[w] for w in part], pa.int64())], ["chunk", "word", "win", "n"])


def _labelled(parts: int, chunk_chars: int):
    """From (part, text, ...) in scan order: batches of one chunk and about SLICE bytes, with its label. Chunks end by text length alone, so every pass cuts alike."""

    def run(batches):
        number = chars = 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                ends = chars + np.cumsum(sizes[at:])
                stop = at + 1 + int(np.searchsorted(ends, min(chunk_chars, chars + SLICE)))
                stop = min(stop, batch.num_rows)
                yield number * parts + batch.column(0)[0].as_py(), batch.slice(at, stop - at)
                chars = int(ends[stop - at - 1])
                if chars >= chunk_chars:
                    number, chars = number + 1, 0
                at = stop

    return run


def _levels(keys: np.ndarray, n: np.ndarray, k: int):
    """Counts of (context of k bytes, symbol): each row's pair, the pairs' counts and contexts."""
    pair = keys if k == ORDER else (keys >> (8 * (ORDER - k + 1)) << 8) | (keys & 255)
    pairs, row = np.unique(pair, return_inverse=True)
    return row, np.bincount(row, n, len(pairs)), pairs >> 8


def _escape(out: np.ndarray, done: np.ndarray, mine: np.ndarray, left_n: np.ndarray, left_q: np.ndarray) -> None:
    """One order's share of the log-probabilities: rows whose symbol occurs end here, others pay the escape."""
    live = ~done & (left_q > 0)
    hit = live & (mine > 0)
    miss = live & ~hit
    out[hit] += np.log10((2 * mine[hit] - 1) / (2 * left_n[hit]))
    out[miss] += np.log10(left_q[miss] / (2 * left_n[miss]))
    done |= hit


def short_log10(pair: np.ndarray, n: np.ndarray, one: np.ndarray):
    """Of windows of two context bytes, all of a context here: the context's count, its distinct symbols, and the
    log-probability from order 1 down once the context's symbols are excluded.

    one[c, s]: how often s followed byte c in training, over the whole corpus.
    """
    contexts, of = np.unique(pair >> 8, return_inverse=True)
    total, distinct = np.bincount(of, n, len(contexts))[of], np.bincount(of, n > 0, len(contexts))[of]
    c, symbol, zero = pair >> 16, pair & 255, one.sum(0)
    out, done = np.zeros(len(pair)), np.zeros(len(pair), bool)
    gone = np.bincount(of, np.where(n > 0, one[c, symbol], 0), len(contexts))[of]
    _escape(out, done, one[c, symbol], one.sum(1)[c] - gone, (one > 0).sum(1)[c] - distinct)
    gone = ((one > 0) * zero[None, :]).sum(1)[c]
    _escape(out, done, zero[symbol], zero.sum() - gone, (zero > 0).sum() - (one > 0).sum(1)[c])
    out[~done] -= np.log10(ALPHABET - (zero > 0).sum())
    return total, distinct, out


def window_log10(win: np.ndarray, n: np.ndarray, n2: np.ndarray, total2: np.ndarray, distinct2: np.ndarray, below2: np.ndarray) -> np.ndarray:
    """log10 probabilities of packed windows, all that share three context bytes here.

    n2: the count of the window's symbol after its last two context bytes; the others
    are what short_log10 gives of that pair.
    """
    levels = {k: _levels(win, n, k) for k in range(ORDER, 2, -1)}
    out, done = np.zeros(len(win)), np.zeros(len(win), bool)
    gone_n, gone_q = np.zeros(len(win)), np.zeros(len(win))
    for k in range(ORDER, 2, -1):
        row, cnt, ctx = levels[k]
        contexts, of = np.unique(ctx, return_inverse=True)
        distinct = np.bincount(of, cnt > 0, len(contexts))[of[row]]
        _escape(out, done, cnt[row], np.bincount(of, cnt, len(contexts))[of[row]] - gone_n, distinct - gone_q)
        # what the context's symbols count for one order down
        down = np.zeros(len(cnt))
        down[row] = n2 if k == 3 else levels[k - 1][1][levels[k - 1][0]]
        gone_n, gone_q = np.bincount(of, np.where(cnt > 0, down, 0), len(contexts))[of[row]], distinct
    _escape(out, done, n2, total2 - gone_n, distinct2 - gone_q)
    out[~done] += below2[~done]
    return out


def _by_groups(shift: int, body, names: list[str]):
    """From rows sorted by their first column: body over blocks of whole groups (the first column, shifted), a bounded number of rows at a time beyond a group."""

    def run(batches):
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            if sum(b.num_rows for b in wait) < 500_000:
                continue
            table = pa.Table.from_batches(wait)
            group = table[0].to_numpy() >> shift
            cut = int(np.searchsorted(group, group[-1]))
            wait = table.slice(cut).combine_chunks().to_batches()
            if cut:
                yield from emit(table.slice(0, cut))
        if wait:
            yield from emit(pa.Table.from_batches(wait))

    def emit(table):
        out = body(*(c.to_numpy() for c in table.columns))
        for at in range(0, len(out[0]), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _ROWS]) for x in out], names)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Score every text by a byte-level PPM model pretrained on the documents not held out.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram
    words) and score, one row per input row; all sums are log10. A null text counts
    as empty: it has the end token alone. A null id is never held out. Repeated rows
    each get a row and are spread over tasks as they lie. A text of any length is
    read whole, by slices; what must fit in memory is one text and the distinct words
    and windows of a chunk. Ties cannot occur. Other columns are ignored, whatever
    their names. An empty table gives an empty result. The tables that the result
    reads stay in the shared folder.
    """
    spark = docs.sparkSession
    rows = placed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    parts = max(1, rows.rdd.getNumPartitions())
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), "text", held_out(F.col("id"), modulus, remainder).alias("held"), "id")
    cut = _labelled(parts, chunk_chars)

    def gather(batches):
        label, chunk = None, None
        for now, batch in cut(batches):
            if now != label:
                if chunk is not None:
                    yield from chunk.rows(label)
                label, chunk = now, _Chunk()
            chunk.add(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())
        if chunk is not None:
            yield from chunk.rows(label)

    keys = stored(rows.mapInArrow(gather, "chunk long, word binary, win long, n long"), "ppm-keys")
    asked_words = keys.where("word is not null").select("chunk", "word", "n")
    asked_wins = keys.where("win is not null").select("chunk", "win", "n")
    words = stored(asked_words.groupBy("word").agg(F.sum("n").alias("c")), "ppm-words")
    wins = stored(asked_wins.groupBy("win").agg(F.sum("n").alias("n")), "ppm-windows")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()

    # contexts of two bytes: 252^3 rows at most; of one byte: 65,536, brought here
    pair = F.shiftleft(F.shiftright("win", 32), 8).bitwiseOR(F.col("win").bitwiseAND(255))
    pairs = stored(wins.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")), "ppm-pairs")
    one = np.zeros((256, 256))
    for r in pairs.where("n > 0").groupBy(F.shiftright("pair", 16).cast("int").alias("c"), F.col("pair").bitwiseAND(255).cast("int").alias("s")).agg(F.sum("n").alias("n")).collect():
        one[r.c, r.s] = r.n
    tasks = default_partitions(spark)
    short = _by_groups(8, lambda p, n: (p, n, *short_log10(p, n, one)), ["pair", "n2", "total2", "distinct2", "below2"])
    pairs = pairs.repartition(tasks, F.shiftright("pair", 8)).sortWithinPartitions("pair").select("pair", "n").mapInArrow(short, "pair long, n2 long, total2 double, distinct2 double, below2 double")
    high = wins.withColumn("pair", pair).join(pairs, "pair").select("win", "n", "n2", "total2", "distinct2", "below2")
    high = high.repartition(tasks, F.shiftright("win", 24)).sortWithinPartitions("win")
    scored = stored(high.mapInArrow(_by_groups(24, lambda w, *x: (w, window_log10(w, *x)), ["win", "value"]), "win long, value double"), "ppm-scored")
    none = F.lit(None)
    answers = stored(
        asked_words.select("chunk", "word").join(words.where("c > 0"), "word").select("chunk", "word", none.cast("long").alias("win"), F.col("c").cast("double").alias("value"))
        .unionByName(asked_wins.select("chunk", "win").join(scored, "win").select("chunk", none.cast("binary").alias("word"), "win", "value")), "ppm-answers")
    chunks = 1 + (keys.agg(F.max("chunk")).first()[0] or 0)
    discard(keys, words, wins, scored)
    n_train, base = int(total.n), math.log10(total.n + total.v + 1) if total.n + total.v else 0.0

    kind = docs.schema[id_col].dataType.simpleString()
    texts_at = f"chunk long, word binary, win long, value double, text string, held boolean, id {kind}"
    names = ["chunk", "word", "win", "value", "text", "held", "id"]

    def label(batches):
        for now, b in cut(batches):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now), pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), b.column(1), b.column(2), b.column(3)], names)

    def score(batches):
        at, known, win, value, got = None, {}, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            labels = table["chunk"].to_numpy()
            for begin, stop in zip(b := _runs(labels), [*b[1:], len(labels)], strict=True):
                rows = table.slice(begin, stop - begin)
                if labels[begin] != at:
                    at, known, win, value, got = labels[begin], {}, None, None, []
                asked = rows["text"].is_valid()
                answered = rows.filter(pa.compute.invert(asked))
                rows = rows.filter(asked)
                if answered.num_rows:
                    of_word = answered.filter(answered["word"].is_valid())
                    known.update(zip(of_word["word"].to_pylist(), of_word["value"].to_pylist(), strict=True))
                    of_win = answered.filter(answered["win"].is_valid())
                    got.append((of_win["win"].to_numpy(), of_win["value"].to_numpy()))
                if not rows.num_rows:
                    continue
                if win is None:
                    win, value = (np.concatenate(x) for x in zip(*got, strict=True))
                    order, got = np.argsort(win), []
                    win, value = win[order], value[order]
                ends = np.cumsum(pa.compute.binary_length(rows["text"]).to_numpy())
                cuts = [0, *(1 + np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE))), rows.num_rows]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if z > a:
                        yield scores(rows.slice(a, z - a), known, win, value)

    def scores(rows, known, win, value):
        split = [words_of(raw) for raw in rows["text"].combine_chunks().cast(pa.binary()).to_pylist()]
        lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
        counts = np.fromiter((known.get(w, 0.0) for words in split for w in [*words, b"\n"]), np.float64, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        total = np.zeros(len(split))
        for first, n, packed in slices(map(spelled, split)):
            keys = packed >> np.uint64(16)
            begin = _runs(keys)
            each = keys[begin].view(np.int64)
            found = np.minimum(np.searchsorted(win, each), len(win) - 1)
            if not np.array_equal(win[found], each):
                raise ValueError("the input's rows have moved between two passes")
            per = np.repeat(value[found], np.diff(np.append(begin, len(keys))))
            total[first : first + n] += np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), per, n)
        return pa.RecordBatch.from_arrays([
            rows["id"].combine_chunks(), rows["held"].combine_chunks(), pa.array(lengths), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
            pa.array(np.full(len(split), n_train, np.int64)), pa.array(np.add.reduceat(np.log10(counts + 1), starts) - lengths * base), pa.array(total),
        ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # texts come first in the union, so each part keeps the number under which the first pass saw it
    texts = rows.mapInArrow(label, texts_at)
    both = texts.unionByName(answers.select("chunk", "word", "win", "value", none.cast("string").alias("text"), none.cast("boolean").alias("held"), none.cast(kind).alias("id")))
    targets = min(chunks, tasks)
    dealt = both.repartitionById(targets, F.pmod("chunk", F.lit(targets)).cast("int")).sortWithinPartitions("chunk", F.col("text").isNotNull())
    out = dealt.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)

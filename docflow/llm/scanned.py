"""Text of scanned pages repaired: running headers, broken words, misread characters, reflow.

Steps, all over whole tables: (1) lines at the pages' edges that recur within a source, count its pages or stand
apart are furniture; (2) skip-gram vectors are trained on the co-occurrences of all words, part by part of the
table and averaged, and every form of a word, however rare, has its place among them by the contexts it was seen
in; (3) a rare form is linked to a frequent word if the two are neighbours in that space and plausible glyph
edits lead from the one to the other; (4) at each occurrence the linked word that fits the context best is chosen;
(5) halves of words broken at a line's or page's end are put together if the whole is written elsewhere; (6) what
is left is joined into paragraphs.

Which of the conditions of a link is tested first makes no difference to the links. Pairs are found by a join on a
key that the edits don't change, then held against the vectors, then against the edits: no search over all pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from docflow.llm.lookalikes import Canon
from docflow.operators.content import running_total
from docflow.session import Stage

# What is printed and what recognition makes of it.
GLYPH_EDITS = """e c|c e|t f|n u|u n|a o|i l|s 5|o 0|l 1|c (|d cl|m rn|g q|h b|b 6|é 6|ó 6|in m|w vv|li h|fi h|ü ii|B 8|S 5|O 0|i 1|l i|e o|rn m|d (l|m ru|2 z"""
#: A form is taken for a misread one if the word it comes from is so many times as frequent.
TIMES = 8
#: The same where the engine itself was unsure of the word.
TIMES_UNSURE = 3
UNSURE = 80
#: Rows of either table of vectors, into which words are hashed; numbers in a vector; words on either side that
#: count as context.
BUCKETS, DIMENSIONS, REACH = 1 << 15, 24, 2
#: Words that weren't met for each pair, and words of which these are drawn in one step.
NOISE, SHARED = 4, 128
#: Times that the parts' models are averaged, and passes over a part's pairs between.
ROUNDS, PASSES = 2, 6
#: Words of which one is to be the other misread have at least this cosine.
NEAR = 0.1
#: The same for forms of two and three letters, from which an edit leads to many words.
CLOSE = 0.5
#: Frequent words that a task knows to need no looking up.
TRUSTED = 20_000

_HYPHENS = "-\u00ad\u00ac\u2010="
_CORE = re.compile(r"^[^\w(]+|[^\w(]+$")
_NUMBER = re.compile(r"(?i)^[\W_]*(?:[ivxlcdm]+|[\dolb]+)[\W_]*$")
_COUNTING = re.compile(r"\d+|\b[ivxlcdm]+\b")
_BAD_NUMBER = re.compile(r"^[(\[$€£]?(?:[A-Z]{2}-)?(?=[\dolbzIOSBZ.,/:%-]*\d)[\dolbzIOSBZ.,/:%-]*[olbzIOSBZ][\dolbzIOSBZ.,/:%-]*$")
_PLAIN_NUMBER = re.compile(r"^[\W\d_]*$")
_FOLD = str.maketrans({"e": "c", "(": "c", "0": "o", "a": "o", "f": "t", "u": "n", "l": "i", "1": "i", "5": "s", "q": "g", "b": "h", "6": "h", "8": "h", "é": "h", "ó": "h", "|": "i", "z": "2", "d": "ci", "w": "vv", "ü": "ii"})


def core(word: str) -> str:
    """A word without marks around it, in lower case."""
    return _CORE.sub("", word).lower()


def fold(word: str) -> str:
    """What the edits of single glyphs leave of a word; equal for a word and what it is misread as by them."""
    return word.translate(_FOLD)


def fold_keys(word: str) -> list[str]:
    """Keys under which a form meets the word it stands for: folded, with each glyph that may take the place of
    two written as either pair."""
    pairs = [(m, h) for m in ("m", "rn", "in") for h in ("h", "ii", "ti")]
    base = fold(word)
    return sorted({base.replace("m", m).replace("h", h) for m, h in pairs})


_EDITS: list[tuple[str, str]] = [tuple(e.split(" ")) for e in GLYPH_EDITS.lower().split("|")]


def edits_between(printed: str, read: str, most: int = 4) -> int | None:
    """How many glyph edits make ``read`` of ``printed``; None if none up to ``most`` do."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(printed) + 1):
        for j in range(max(0, i - most), min(len(read), i + most) + 1):
            cost = best.get((i, j))
            if cost is None:
                continue
            if i < len(printed) and j < len(read) and printed[i] == read[j]:
                key = (i + 1, j + 1)
                best[key] = min(best.get(key, 99), cost)
            if cost < most:
                for a, b in _EDITS:
                    if printed.startswith(a, i) and read.startswith(b, j):
                        key = (i + len(a), j + len(b))
                        best[key] = min(best.get(key, 99), cost + 1)
    return best.get((len(printed), len(read)))


def is_bad_number(word: str) -> bool:
    """A number, date or reference with letters in place of digits."""
    bare = word.strip(".,;:()[]")
    return bool(_BAD_NUMBER.match(bare)) and len(bare) > 1 and sum(c.isdigit() for c in bare) * 2 >= sum(c.isalpha() for c in bare.split("-")[-1])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: a page's words take far more room as Python objects than in Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# -- pages ---------------------------------------------------------------------------------------------


class Words:
    """The words of some pages, column by column: page ``p`` has those from ``starts[p]`` to ``starts[p + 1]``."""

    def __init__(self, column: pa.Array):
        sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        flat = column.flatten()
        self.fields = dict(zip((f.name for f in flat.type), flat.flatten()))
        self.text: list[str | None] = self.fields["text"].to_pylist()

    def numbers(self, name: str) -> np.ndarray:
        """A whole-number column; null is -1, as where the engine gives none."""
        return pc.fill_null(self.fields[name], -1).to_numpy(zero_copy_only=False)

    def line_starts(self) -> np.ndarray:
        """Places at which a line begins."""
        block, line = self.numbers("block"), self.numbers("line")
        first = np.ones(len(block), dtype=bool)
        first[1:] = (block[1:] != block[:-1]) | (line[1:] != line[:-1])
        first[self.starts[:-1][self.starts[:-1] < len(block)]] = True
        return np.flatnonzero(first)


def skeleton(text: str, page: int) -> tuple[str, int | None]:
    """A line with its glyph edits and numbers levelled, and a number of it minus the page's, if there is one."""
    text = text.lower()
    numbers = [int(n) for n in re.findall(r"\b\d{1,5}\b", text)]
    level = re.sub(r"[^\w]+", "", fold(re.sub(r"\d+", "", re.sub(r"\s+", " ", text))))
    return level, (numbers[0] - page if numbers else None)


def _roman(text: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    bare = re.sub(r"\W", "", text.lower())
    if not bare or any(c not in value for c in bare):
        return None
    total = 0
    for a, b in zip(bare, [*bare[1:], "i"]):
        total += -value[a] if value[a] < value[b] else value[a]
    return total


EDGE_FIELDS = StructType(
    [
        StructField("source_id", StringType()),
        StructField("page_no", IntegerType()),
        StructField("top", BooleanType()),
        StructField("depth", IntegerType()),
        StructField("first", IntegerType()),
        StructField("last", IntegerType()),
        StructField("level", StringType()),
        StructField("ahead", IntegerType()),
        StructField("apart", BooleanType()),
        StructField("alone", BooleanType()),
    ]
)
#: Lines from an edge that may be furniture by standing apart or being set off; further ones only by recurring.
OUTER = 2


def edge_lines(words: Words, pages: list[int], own_blocks: bool = True) -> Iterator[tuple]:
    """Lines from either edge of each page inwards, up to the first body block, as candidates for furniture.

    With ``own_blocks`` a header or footer has blocks of its own; without, as in plain page texts, the outermost
    line of a paragraph may be one, but only by recurring or counting.
    """
    begins = words.line_starts()
    if not len(begins):
        return
    ends = np.r_[begins[1:], words.starts[-1]]
    box = words.fields["box"]
    x0, y0, y1 = (pc.fill_null(f, 0.0).to_numpy(zero_copy_only=False) for f in (pc.struct_field(box, c) for c in ("x0", "y0", "y1")))
    tops, bottoms, lefts = np.minimum.reduceat(y0, begins), np.maximum.reduceat(y1, begins), x0[begins]
    line_block = words.numbers("block")[begins]
    for p, page in enumerate(pages):
        a, b = np.searchsorted(begins, words.starts[p : p + 2])
        n, at = int(b - a), int(words.starts[p])
        if not n:
            continue
        blocks = line_block[a:b].tolist()
        sizes = Counter(blocks)
        left, top_y, bottom_y = lefts[a:b].tolist(), tops[a:b].tolist(), bottoms[a:b].tolist()
        margin = Counter(map(round, left)).most_common(1)[0][0]
        height = float(np.median(bottoms[a:b] - tops[a:b])) or 1.0
        for top, order in ((True, range(n)), (False, range(n - 1, 0 if n > 1 else -1, -1))):
            for depth, k in enumerate(order):
                inside = sizes[blocks[k]] > 1
                if inside and (own_blocks or k not in (0, n - 1)):
                    break  # part of a paragraph, as is what lies further in
                first, last = int(begins[a + k]), int(ends[a + k])
                text = " ".join(w or "" for w in words.text[first:last])
                level, ahead = skeleton(text, page)
                roman = _roman(text) if last - first <= 3 and _NUMBER.match(text) else None
                if roman is not None:
                    level, ahead = "", roman - page
                gap = top_y[k + 1] - bottom_y[k] if top and k + 1 < n else top_y[k] - bottom_y[k - 1] if not top and k else 0.0
                outer = depth < OUTER and not inside
                # Set off from the body's margin and no sentence.
                alone = abs(left[k] - margin) > 3 and not text.rstrip().endswith((".", ",", ";", ":")) and n > 2
                yield p, top, depth, first - at, last - at - 1, level, ahead, outer and gap > 4 * height, outer and alone
                if inside:
                    break


def furniture(pages: DataFrame, stage: Stage, own_blocks: bool = True) -> DataFrame:
    """``source_id, page_no, ranges`` with the words (first and last) of running headers, footers, page numbers.

    An edge line is furniture if its level recurs at that edge on another page of the source and the line stands
    alone or counts the pages or has no number; if it stands far apart from the body; or if it is set off. A line
    further in is only if all lines between it and the edge are.
    """

    def run(batches):
        for batch in _small(batches, 512):
            sources, numbers = batch.column("source_id").to_pylist(), [n or 0 for n in batch.column("page_no").to_pylist()]
            rows = [(sources[p], numbers[p], *e) for p, *e in edge_lines(Words(batch.column("words")), numbers, own_blocks)]
            yield _rows_batch(rows, EDGE_FIELDS)

    edges = stage.put(pages.mapInArrow(run, EDGE_FIELDS))
    # Lines that count the pages are told apart by what they count; each line meets one row of either sum.
    edges = edges.withColumn("ahead_key", F.coalesce("ahead", F.lit(-(1 << 31))))
    recurring = edges.groupBy("source_id", "top", "level").agg(F.count("*").alias("pages"))
    counting = edges.groupBy("source_id", "top", "level", "ahead_key").agg(F.count("*").alias("steady"))
    joined = edges.join(recurring, ["source_id", "top", "level"]).join(counting, ["source_id", "top", "level", "ahead_key"])
    recurs = (F.col("pages") >= 2) & (F.length("level") >= 4) & F.col("ahead").isNull()
    counts = F.col("ahead").isNotNull() & (F.col("steady") >= 2)
    marked = joined.withColumn("is", F.col("apart") | recurs | counts | F.col("alone"))
    inwards = Window.partitionBy("source_id", "page_no", "top").orderBy("depth")
    outwards = F.min(F.col("is")).over(inwards)
    kept = marked.withColumn("chain", outwards).filter(F.when(F.col("depth") < OUTER, F.col("is")).otherwise(F.col("chain")))
    return kept.groupBy("source_id", "page_no").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def _rows_batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)


# -- words ---------------------------------------------------------------------------------------------


class Reader:
    """Words of pages as texts in one form of characters and as cores; what was seen is remembered."""

    def __init__(self) -> None:
        self.canon = Canon({})
        self.cores = _Remember(core)
        self.odd = _Remember(lambda w: not w.isascii() and self.canon.odd(w))

    def texts(self, words: Words) -> list[str]:
        """Look-alikes made one and no blanks around; null words are empty."""
        out = [w or "" for w in words.text]
        suspects = [k for k, w in enumerate(out) if self.odd[w]]
        for p in sorted({int(np.searchsorted(words.starts, k, side="right")) - 1 for k in suspects}):
            a, b = words.starts[p : p + 2]
            for k, new in self.canon.words(words.text[a:b]):
                out[a + k] = new
        return [w if w.isascii() else w.strip() for w in out]


class _Remember(dict):
    """Results of a function, forgotten when there are too many."""

    MOST = 300_000

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= self.MOST:
            self.clear()
        value = self[key] = self.function(key)
        return value


_SEEN = StructType([StructField("word", StringType()), *(StructField(c, IntegerType()) for c in "ac"), StructField("n", LongType())])


def seen(pages: DataFrame) -> DataFrame:
    """What the pages hold, counted within each part of the table, in one pass: ``word, n`` of every form, look-alike
    characters made one and broken halves left out; and ``a, c, n`` of words and the folded words near them, as rows
    of the tables of vectors."""

    def run(batches):
        reader, inputs, contexts = Reader(), _Remember(bucket), _Remember(lambda w: bucket(fold(w)))
        counts: Counter = Counter()
        codes, held = [], 0
        for batch in _small(batches, 512):
            words = Words(batch.column("words"))
            texts = reader.texts(words)
            cores = [reader.cores[w] for w in texts]
            whole = np.ones(len(texts) + 1, dtype=bool)
            last = set((words.starts[1:] - 1).tolist())
            halves = [k for k, w in enumerate(texts) if w and w[-1] in _HYPHENS and k not in last]
            whole[halves] = False
            whole[np.array(halves, dtype=np.int64) + 1] = False
            counts.update(w for w, fine in zip(cores, whole.tolist()) if w and fine)
            a, c = _in_rows(words, cores, inputs), _in_rows(words, cores, contexts)
            for d in range(1, REACH + 1):
                for x, y in ((a[:-d], c[d:]), (a[d:], c[:-d])):
                    fine = (x >= 0) & (y >= 0)
                    codes.append(x[fine] * BUCKETS + y[fine])
                    held += len(codes[-1])
            if held > 4_000_000:
                yield pairs(codes)
                codes, held = [], 0
            if len(counts) > _Remember.MOST:
                yield words_of(counts)
                counts.clear()
        yield words_of(counts)
        yield pairs(codes)

    def words_of(counts):
        items = [(w, None, None, n) for w, n in counts.items() if not _PLAIN_NUMBER.match(w)]
        return _rows_batch(items, _SEEN)

    def pairs(codes):
        found, n = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True)
        columns = [pa.nulls(len(n), pa.string()), *(pa.array(x.astype(np.int32)) for x in (found // BUCKETS, found % BUCKETS)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=_SEEN.names)

    return pages.select("words").mapInArrow(run, _SEEN)


def _plain(canon: Canon, words: list[str | None]) -> list[str]:
    """Words with look-alikes made one and no blanks around them; null words are empty."""
    out = [w or "" for w in words]
    for k, new in canon.words(words):
        out[k] = new
    return [w if w.isascii() else w.strip() for w in out]


def glyph_pairs(counts: DataFrame) -> DataFrame:
    """``word, printed, n, m``: forms and the words, more frequent by far, that share a key with them."""
    key_schema = StructType([*counts.schema.fields, StructField("keys", ArrayType(StringType()))])

    def keyed(batches):
        for batch in batches:
            keys = [fold_keys(w) if len(w) >= 2 else [] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys, pa.list_(pa.string()))], names=key_schema.names)

    with_keys = counts.mapInArrow(keyed, key_schema)
    rare = with_keys.select("word", "n", F.explode("keys").alias("key"))
    often = with_keys.filter((F.col("n") >= TIMES_UNSURE) & ~F.col("word").rlike(r"[0-9(|]")).select(
        F.col("word").alias("printed"), F.col("n").alias("m"), F.explode("keys").alias("key")
    )
    pairs = rare.join(often, "key").filter((F.col("m") >= TIMES_UNSURE * F.col("n")) & (F.col("word") != F.col("printed")))
    return pairs.select("word", "printed", "n", "m").distinct()


def link_forms(counts: DataFrame, places: DataFrame, near: float = NEAR) -> DataFrame:
    """``word, n, candidates``: for every form the words it may be misread from, with counts, edits and nearness.

    ``places`` has the vectors of forms (``word, vector``). A form without a context has no place and no link.
    """
    pairs = glyph_pairs(counts)
    there = pairs.join(places.withColumnRenamed("vector", "x"), "word").join(
        places.select(F.col("word").alias("printed"), F.col("vector").alias("y")), "printed"
    )
    schema = StructType(pairs.select("word", "printed", "m").schema.fields).add("edits", IntegerType()).add("near", FloatType())

    def judged(batches):
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS) for c in "xy")
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            cosine = (x * y).sum(axis=1) / np.where(size > 0, size, 1.0)
            words, printed = batch.column("word").to_pylist(), batch.column("printed").to_pylist()
            edits = [edits_between(p, w) if c >= near else None for p, w, c in zip(printed, words, cosine)]
            keep = pa.array([k for k, e in enumerate(edits) if e is not None], pa.int64())
            columns = [batch.column(c).take(keep) for c in ("word", "printed", "m")]
            columns += [pa.array([e for e in edits if e is not None], pa.int32()), pa.array(cosine, pa.float32()).take(keep)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    good = there.select("word", "printed", "m", "x", "y").mapInArrow(judged, schema)
    lists = good.groupBy("word").agg(F.collect_list(F.struct("m", "printed", "edits", "near")).alias("candidates"))
    return counts.join(lists, "word", "left")


# -- context -------------------------------------------------------------------------------------------


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class SkipGram:
    """Skip-gram vectors with negative sampling: ``inputs`` of words and ``contexts`` of folded words.

    Contexts are folded, so that a misread neighbour says the same as the word that was printed. Words are hashed
    into the rows of both tables, so the model has one size however many words there are.
    """

    def __init__(self, inputs: np.ndarray, contexts: np.ndarray):
        self.inputs, self.contexts = inputs.astype(np.float32), contexts.astype(np.float32)

    @classmethod
    def start(cls, seed: int = 11) -> SkipGram:
        rng = np.random.default_rng(seed)
        return cls(*(rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)) for _ in range(2)))

    def trained(self, a: np.ndarray, c: np.ndarray, n: np.ndarray, rate: float, seed: int = 3) -> SkipGram:
        """A model after ``PASSES`` over all pairs of word ``a`` and context ``c``, seen ``n`` times."""
        u, v = self.inputs.copy(), self.contexts.copy()
        rng = np.random.default_rng(seed)
        weight = 1 + np.log(n)
        weight = (weight / weight.mean()).astype(np.float32)
        noise = np.cumsum(np.bincount(c, weights=n.astype(float), minlength=BUCKETS) ** 0.75)
        noise /= noise[-1]
        # The words that weren't met are drawn once for all pairs of a step, each for its share of those it stands for.
        size, step, share = 8192, 0, np.float32(NOISE / SHARED)
        steps = PASSES * -(-len(a) // size)
        for _ in range(PASSES):
            order = rng.permutation(len(a))
            for at in range(0, len(a), size):
                pick = order[at : at + size]
                now, step = np.float32(rate * (1 - step / steps) + 0.01), step + 1
                other = np.searchsorted(noise, rng.random(SHARED), side="right").clip(max=BUCKETS - 1)
                x, y, z = u[a[pick]], v[c[pick]], v[other]
                near = (_sigmoid((x * y).sum(axis=1)) - 1) * weight[pick]
                far = _sigmoid(x @ z.T) * (share * weight[pick])[:, None]
                _descend(u, a[pick], near[:, None] * y + far @ z, now)
                _descend(v, np.r_[c[pick], other], np.vstack([near[:, None] * x, far.T @ x]), now)
        return SkipGram(u, v)

    def surroundings(self, around: list[str]) -> np.ndarray | None:
        """The mean vector of the words around a place."""
        near = [bucket(fold(w)) for w in around if w]
        return self.contexts[near].mean(axis=0) if near else None

    def fit(self, word: str, place: np.ndarray | None) -> float:
        """How well ``word`` stands among surroundings; 0 if there are none."""
        return 0.0 if place is None else float(np.clip(self.inputs[bucket(word)] @ place, -5, 5))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _descend(table: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """A step for each row of ``table`` that has gradients; steps are bounded, as a row may have very many."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    total = np.add.reduceat(gradient[order], first, axis=0)
    count = np.diff(np.r_[first, len(own)])
    table[own[first]] -= np.clip(rate * total / np.sqrt(count, dtype=np.float32)[:, None], -0.3, 0.3)


def _in_rows(words: Words, cores: list[str], of: _Remember) -> np.ndarray:
    """Numbers of the words, pages kept apart by ``REACH`` places with -1; words without a core are -1."""
    ids = np.fromiter((of[w] if w else -1 for w in cores), np.int64, len(cores))
    page = np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
    out = np.full(len(ids) + REACH * len(words.starts), -1, dtype=np.int64)
    out[np.arange(len(ids)) + REACH * page] = ids
    return out


_VECTOR = [StructField(f"v{k}", DoubleType()) for k in range(DIMENSIONS)]


def skip_gram(pairs: DataFrame) -> SkipGram:
    """Trained on all co-occurrences: each part of the table trains on its own, from the model of the round before,
    and rows of the tables are averaged by how much each part saw of them. The driver holds two tables of
    ``BUCKETS`` rows."""
    model = SkipGram.start()
    schema = StructType([StructField("side", IntegerType()), StructField("row", IntegerType()), StructField("weight", DoubleType()), *_VECTOR])
    for turn in range(ROUNDS):
        rate = 0.4 / (1 + turn)

        def run(batches, model=model, rate=rate):
            held = [[b.column(k).to_numpy() for k in range(3)] for b in batches]
            a, c, n = (np.concatenate(x).astype(np.int64) for x in zip(*held)) if held else ([], [], [])
            if not len(a):
                return
            own = model.trained(a, c, n, rate)
            for side, rows, table in ((0, a, own.inputs), (1, c, own.contexts)):
                weight = np.bincount(rows, weights=n.astype(float), minlength=BUCKETS)
                seen = np.flatnonzero(weight)
                columns = [np.full(len(seen), side, np.int32), seen.astype(np.int32), weight[seen], *(table[seen].T.astype(np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=schema.names)

        means = [(F.sum(F.col(f.name) * F.col("weight")) / F.sum("weight")).alias(f.name) for f in _VECTOR]
        rows = pairs.mapInArrow(run, schema).groupBy("side", "row").agg(*means).toPandas()
        tables = [model.inputs.copy(), model.contexts.copy()]
        for side, table in enumerate(tables):
            own = rows[rows.side == side]
            table[own.row.to_numpy()] = own[[f.name for f in _VECTOR]].to_numpy()
        model = SkipGram(*tables)
    return model


def places_of(pages: DataFrame, model: SkipGram, stage: Stage) -> DataFrame:
    """``word, vector``: where each form lies among the vectors, by the contexts of all its occurrences; the mean
    of all occurrences of all forms is the origin."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType()), *_VECTOR])

    def run(batches):
        reader, contexts = Reader(), _Remember(lambda w: bucket(fold(w)))
        table = np.vstack([model.contexts, np.zeros((1, DIMENSIONS), np.float32)])  # the last row is that of no word
        for batch in batches:
            ids: dict[str, int] = {}
            sums, seen = np.zeros((0, DIMENSIONS)), np.zeros(0, dtype=np.int64)
            for part in _small([batch], 512):
                words = Words(part.column("words"))
                cores = [reader.cores[w] for w in reader.texts(words)]
                near = _in_rows(words, cores, contexts)
                own = _in_rows(words, cores, _Numbering(ids))
                vectors, there = table[near], (near >= 0).astype(np.float64)
                total, count = np.zeros_like(vectors, dtype=np.float64), np.zeros(len(near))
                for d in range(1, REACH + 1):
                    total[d:] += vectors[:-d]
                    total[:-d] += vectors[d:]
                    count[d:] += there[:-d]
                    count[:-d] += there[d:]
                fine = np.flatnonzero((own >= 0) & (count > 0))
                if len(ids) > len(sums):
                    sums = np.vstack([sums, np.zeros((len(ids) - len(sums), DIMENSIONS))])
                    seen = np.r_[seen, np.zeros(len(ids) - len(seen), dtype=np.int64)]
                order = fine[np.argsort(own[fine], kind="stable")]
                if len(order):
                    first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                    sums[own[order][first]] += np.add.reduceat(total[order] / count[order][:, None], first, axis=0)
                    seen += np.bincount(own[order], minlength=len(seen))
            kept = np.flatnonzero(seen)
            names = list(ids)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kept], pa.string()), pa.array(seen[kept]), *(pa.array(x) for x in sums[kept].T)], names=schema.names)

    sums = [F.sum(c).alias(c) for c in ("n", *(f.name for f in _VECTOR))]
    each = stage.put(pages.select("words").mapInArrow(run, schema).groupBy("word").agg(*sums))
    whole = each.agg(*sums).first()
    origin = [whole[f.name] / whole.n if whole.n else 0.0 for f in _VECTOR]
    numbers = [(F.col(f.name) / F.col("n") - F.lit(o)).cast("float") for f, o in zip(_VECTOR, origin)]
    return each.select("word", F.array(*numbers).alias("vector"))


class _Numbering(dict):
    """Numbers for keys in the order in which they come, kept in ``ids``."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self.ids = ids

    def __missing__(self, key: str) -> int:
        self.ids[key] = self[key] = number = len(self.ids)
        return number


def choose(model: SkipGram, word: str, n: int, candidates: list, around: list[str], conf: int) -> str | None:
    """The word that ``word`` is misread from, or None if it may well be what was printed.

    Linked words are weighed by frequency, edits, nearness and how well they stand in the context; forms seen more
    than a few times need a far more frequent word, short forms also one that is met in the same contexts.
    """
    times = TIMES_UNSURE if 0 <= conf < UNSURE else TIMES
    odd = any(c in "0156(8" for c in word) and any(c.isalpha() for c in word)
    place = model.surroundings(around)
    best, most, close = None, -1e9, 0.0
    for m, printed, edits, near in candidates:
        if m < (TIMES_UNSURE if odd else times) * n:
            continue
        score = np.log(m / n) - 1.2 * edits + near + model.fit(printed, place)
        if score > most:
            best, most, close = printed, score, near
    if best is None:
        return None
    if odd or n <= 2 and len(word) > 4:
        return best
    ratio = candidates_ratio(best, candidates, n)
    if len(word) > 3:
        return best if most > 1.0 and ratio >= (times if len(word) > 4 else 2 * times) else None
    fine = ratio >= 4 * times and close >= CLOSE
    # Two letters are as often another word of the language, which its own contexts tell.
    return best if fine and (len(word) > 2 or model.fit(best, place) >= model.fit(word, place) + 0.2) else None


def candidates_ratio(best: str, candidates: list, n: int) -> float:
    return max(m for m, printed, *_ in candidates if printed == best) / n


# -- the whole -----------------------------------------------------------------------------------------

LOOKUP = StructType(
    [
        StructField("source_id", StringType()),
        StructField("page_no", IntegerType()),
        StructField("word_no", IntegerType()),
        StructField("joined", BooleanType()),
        StructField("word", StringType()),
        StructField("head", StringType()),
        StructField("conf", IntegerType()),
        StructField("around", ArrayType(StringType())),
        StructField("other_page", IntegerType()),
        StructField("other_no", IntegerType()),
    ]
)
FINDING = StructType(
    [
        StructField("source_id", StringType()),
        StructField("page_no", IntegerType()),
        StructField("word_no", IntegerType()),
        StructField("kind", StringType()),
        StructField("printed", StringType()),
    ]
)


class ScannedPages:
    """Findings and repaired text of ``pages`` (``source_id, page_no, words``).

    A repeated page counts once (of different rows under one key the largest). Pages whose words all have the
    confidence 100 have a text layer and no misread words. Blank pages and null words have no findings. ``model``
    takes the place of the vectors that are otherwise trained.
    """

    def __init__(self, pages: DataFrame, stage: Stage | None = None, *, own_blocks: bool = True, model: SkipGram | None = None):
        self.stage = stage or Stage(pages.sparkSession)
        keyed = pages.filter("source_id is not null and page_no is not null")
        one = keyed.groupBy("source_id", "page_no").agg(F.max("words").alias("words"))
        plain = self.stage.put(one)
        edges = furniture(plain, self.stage, own_blocks)
        self.pages = self.stage.put(plain.join(edges, ["source_id", "page_no"], "left"))
        self.stage.drop(plain)
        found = self.stage.put(seen(self.pages))
        counts = self.stage.put(found.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        self.counts = counts
        self.model = model or skip_gram(found.filter("word is null").select("a", "c", "n"))
        self.stage.drop(found)
        self.forms = self.stage.put(link_forms(counts, places_of(self.pages, self.model, self.stage)))
        self.findings = self.stage.put(self._findings())

    def _findings(self) -> DataFrame:
        trusted = frozenset(
            r.word for r in self.forms.filter("candidates is null and not word rlike '[0-9]'").orderBy(F.desc("n"), "word").limit(TRUSTED).select("word").collect()
        )
        keys = ["source_id", "page_no"]
        linked = self.pages.join(self._next_body(), keys, "left").select(*keys, "words", "ranges", "after")

        def run(batches):
            reader = Reader()
            for batch in _small(batches, 512):
                yield _rows_batch(list(lookups(reader, batch, trusted)), LOOKUP)

        asked = self.stage.put(linked.mapInArrow(run, LOOKUP))
        vectors = self.model

        def decide(batches):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    rows += findings_of(vectors, r)
                yield _rows_batch(rows, FINDING)

        # Numbers need no looking up and so don't take part in the join.
        numbers = asked.filter("word is null").withColumns({"n": F.lit(None).cast("bigint"), "candidates": F.lit(None).cast(self.forms.schema["candidates"].dataType)})
        words = asked.filter("word is not null").join(self.forms, "word", "left")
        found = words.unionByName(numbers).mapInArrow(decide, FINDING)
        spans = self.pages.filter("ranges is not null").select(*keys, F.explode("ranges").alias("r"))
        marks = spans.select(
            *keys, F.explode(F.sequence("r.first", "r.last")).alias("word_no"), F.lit("furniture").alias("kind"), F.lit(None).cast("string").alias("printed")
        )
        rank = F.expr("case kind when 'furniture' then 0 when 'hyphen' then 1 else 2 end")
        all_found = marks.unionByName(found).groupBy(*keys, "word_no").agg(F.min(F.struct(rank.alias("rank"), "kind", "printed")).alias("f"))
        return all_found.select(*keys, "word_no", "f.kind", "f.printed")

    def _next_body(self) -> DataFrame:
        """``source_id, page_no, after``: page, place and text of the first body word that follows on later pages,
        over any number of pages without one, but not over pages that are missing."""
        rows = self.pages.select("source_id", "page_no", F.lit(1).alias("one"), self._first_body().alias("f"))
        # Pages that follow one another without a gap are as far from their number in order.
        ranked = running_total(rows, ["source_id"], "page_no", "one", "rank").withColumn("run", F.col("page_no") - F.col("rank"))
        body = F.when(F.col("f").isNotNull(), F.struct("page_no", F.col("f.k").alias("k"), F.col("f.t").alias("t")))
        slim = ranked.select("source_id", "page_no", "run", F.floor(F.col("page_no") / 1000).alias("part"), body.alias("body"))
        ahead = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(1, Window.unboundedFollowing)
        near = slim.withColumn("near", F.first("body", ignorenulls=True).over(ahead(["source_id", "run", "part"], "page_no")))
        parts = slim.groupBy("source_id", "run", "part").agg(F.min("body").alias("b"))
        far = parts.select("source_id", "run", "part", F.first("b", ignorenulls=True).over(ahead(["source_id", "run"], "part")).alias("far"))
        both = near.join(far, ["source_id", "run", "part"], "left")
        return both.select("source_id", "page_no", F.coalesce("near", "far").alias("after"))

    @staticmethod
    def _first_body():
        """Place and text of the first word that isn't furniture."""
        inside = lambda k: F.exists("ranges", lambda r: (k >= r.first) & (k <= r.last))
        places = F.filter(
            F.transform("words", lambda w, k: F.struct(k.alias("k"), w.text.alias("t"))), lambda x: ~F.coalesce(inside(x.k), F.lit(False))
        )
        return F.get(places, 0)

    def repaired(self) -> DataFrame:
        """``source_id, page_no, blocks``: each page's paragraphs, furniture gone, words whole and right, and
        whether the page's last paragraph goes on on the next."""
        keys = ["source_id", "page_no"]
        marks = self.findings.groupBy(*keys).agg(F.collect_list(F.struct("word_no", "kind", "printed")).alias("marks"))
        schema = StructType(self.pages.select(*keys).schema.fields)
        schema = schema.add("blocks", ArrayType(StringType())).add("open", BooleanType()).add("starts_low", BooleanType())

        def run(batches):
            canon = Canon({})
            for batch in _small(batches):
                rows = [(r["source_id"], r["page_no"], *reflow(canon, r["words"] or [], r["marks"] or [])) for r in batch.to_pylist()]
                yield _rows_batch(rows, schema)

        return self.pages.join(marks, keys, "left").select(*keys, "words", "marks").mapInArrow(run, schema)

    def paragraphs(self) -> DataFrame:
        """``source_id, page_no, paragraph_no, text``: each source's paragraphs under the page where they begin."""
        pages = self.stage.put(self.repaired())
        # A paragraph that goes on: pages hang on the nearest earlier one that doesn't begin in its middle.
        before = pages.select("source_id", (F.col("page_no") + 1).alias("page_no"), F.col("open").alias("was_open"))
        slim = pages.select("source_id", "page_no", F.size("blocks").alias("n"), "starts_low").join(before, ["source_id", "page_no"], "left")
        goes_on = F.coalesce("was_open", F.lit(False)) & F.col("starts_low") & (F.col("n") > 0)
        slim = slim.select("source_id", "page_no", goes_on.alias("goes_on"), "n")
        # Pages of a source are numbered in parts, so that no task has to order a whole large source.
        part = F.floor(F.col("page_no") / 1000)
        home = F.when(~F.col("goes_on") | (F.col("n") > 1), F.col("page_no"))
        order = Window.partitionBy("source_id", "part").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
        within = slim.withColumn("part", part).withColumn("home", F.last(home, ignorenulls=True).over(order))
        last = within.groupBy("source_id", "part").agg(F.max(home).alias("h"))
        carried = last.withColumn("carry", F.last("h", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        homes = within.join(carried.select("source_id", "part", "carry"), ["source_id", "part"])
        homes = homes.select("source_id", "page_no", "goes_on", F.coalesce("home", "carry", "page_no").alias("home"))
        rows = pages.join(homes, ["source_id", "page_no"]).select("source_id", "page_no", "goes_on", "home", F.posexplode("blocks").alias("k", "text"))
        joins = F.col("goes_on") & (F.col("k") == 0)
        rows = rows.withColumn("at", F.when(joins, F.col("home")).otherwise(F.col("page_no")))
        counts = pages.select("source_id", F.col("page_no").alias("at"), F.size("blocks").alias("n"))
        rows = rows.join(counts, ["source_id", "at"])
        number = F.when(joins & (F.col("at") != F.col("page_no")), F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("k"))
        rows = rows.select("source_id", F.col("at").alias("page_no"), number.alias("paragraph_no"), F.struct(F.col("page_no").alias("p"), "text").alias("x"))
        grouped = rows.groupBy("source_id", "page_no", "paragraph_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        return grouped.select("source_id", "page_no", "paragraph_no", F.array_join(F.col("xs.text"), " ").alias("text"))


def lookups(reader: Reader, batch: pa.RecordBatch, trusted: frozenset) -> Iterator[tuple]:
    """The words of pages that have to be looked up, alone or joined with their other half."""
    words = Words(batch.column("words"))
    all_texts = reader.texts(words)
    block, line, conf = (words.numbers(c).tolist() for c in ("block", "line", "conf"))
    for p, (source, page, ranges, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source_id", "page_no", "ranges", "after")))):
        at, end = map(int, words.starts[p : p + 2])
        if at == end:
            continue
        texts = all_texts[at:end]
        inside = set()
        for r in ranges or []:
            inside.update(range(r["first"], r["last"] + 1))
        body = [k for k in range(end - at) if k not in inside]
        cores = [reader.cores[t] for t in texts]
        second = set()
        for i, k in enumerate(body):
            text = texts[k]
            if len(text) < 2 or text[-1] not in _HYPHENS or not text[-2].isalpha():
                continue
            other, rest, place = None, "", None
            if i + 1 < len(body):
                nxt = body[i + 1]
                if block[at + nxt] != block[at + k] or line[at + nxt] != line[at + k]:
                    other, rest, place = page, texts[nxt], nxt
                    second.add(nxt)
            elif after and after["t"]:
                other, rest, place = after["page_no"], after["t"], after["k"]
            if other is not None and rest and rest[0].isalpha():
                head = core(text.rstrip(_HYPHENS))
                around = [cores[j] for j in body[max(0, i - REACH) : i]]
                yield (source, page, k, True, head + core(rest), head, conf[at + k], around, other, place)
        if all(c == 100 for c in conf[at:end]):
            continue  # a text layer
        for i, k in enumerate(body):
            word = cores[k]
            if word in trusted or k in second or texts[k] and texts[k][-1] in _HYPHENS:
                continue
            if is_bad_number(texts[k]):
                yield (source, page, k, False, None, texts[k], conf[at + k], [], None, None)
            elif len(word) >= 2 and not _PLAIN_NUMBER.match(word):
                around = [cores[j] for j in body[max(0, i - REACH) : i] + body[i + 1 : i + 1 + REACH]]
                yield (source, page, k, False, word, None, conf[at + k], around, None, None)


def findings_of(model: SkipGram, row: dict) -> Iterator[tuple]:
    """What a looked-up word turns out to be."""
    key = (row["source_id"], row["page_no"], row["word_no"])
    conf = -1 if row["conf"] is None else row["conf"]
    if row["word"] is None:
        digits = row["head"].translate(str.maketrans("olbzIOSBZ", "016210582"))
        prefix = re.match(r"^\W*[A-Z]{2}-", row["head"])
        yield (*key, "misread", (prefix[0] + digits[len(prefix[0]) :]) if prefix else digits)
        return
    n = row["n"]
    candidates = [(c["m"], c["printed"], c["edits"], c["near"]) for c in row["candidates"] or []]
    if not row["joined"]:
        printed = choose(model, row["word"], n, candidates, row["around"], conf) if candidates and n else None
        if printed:
            yield (*key, "misread", printed)
        return
    whole = row["word"]
    printed = choose(model, whole, n, candidates, row["around"], conf) if candidates and n else None
    if printed is None and not n:
        return
    yield (*key, "hyphen", printed or whole)
    if printed and not printed.endswith(whole[len(row["head"]) :]):
        yield (row["source_id"], row["other_page"], row["other_no"], "misread", None)


def reflow(canon: Canon, words: list[dict], marks: list[dict]) -> tuple[list[str], bool, bool]:
    """A page's paragraphs, whether the last one is open, and whether the first one begins in small letters."""
    found = {m["word_no"]: m for m in marks}
    texts = _plain(canon, [w["text"] for w in words])
    blocks: list[list[str]] = []
    block, glue = None, None
    for k, w in enumerate(words):
        mark = found.get(k)
        if mark and mark["kind"] == "furniture" or not texts[k]:
            continue
        if w["block"] != block:
            blocks.append([])
            block = w["block"]
        text = texts[k]
        if mark and mark["kind"] == "misread" and mark["printed"]:
            text = _dress(text, mark["printed"])
        if glue is not None and blocks[-1]:
            tail = re.search(r"[^\w]+$", text)
            blocks[-1][-1] = glue + (tail[0] if tail else "")
            glue = None
        else:
            glue = None
            blocks[-1].append(text)
        if mark and mark["kind"] == "hyphen":
            glue = _dress(text, mark["printed"])
            blocks[-1][-1] = glue
    paragraphs = [" ".join(b) for b in blocks if b]
    if not paragraphs:
        return [], True, False
    # A broken word at the page's end is whole already; its other half begins the next page.
    return paragraphs, not re.search(r"[.!?:…][\"'”»)]*$", paragraphs[-1]), bool(re.match(r"[a-zà-ÿ]", paragraphs[0]))


def _dress(read: str, printed: str) -> str:
    """The printed word with the marks around and the capitals of what was read."""
    bare = read.rstrip(_HYPHENS) if read[-1:] in _HYPHENS else read
    lead = re.match(r"^[^\w(]*", bare)[0]
    tail = re.search(r"[^\w(]*$", bare)[0] if read[-1:] not in _HYPHENS else ""
    inner = bare[len(lead) : len(bare) - len(tail) or None]
    if len(inner) > 1 and inner.isupper():
        printed = printed.upper()
    elif inner[:1].isupper():
        printed = printed[:1].upper() + printed[1:]
    return lead + printed + tail


def pages_of_texts(page_texts: DataFrame, text: str) -> DataFrame:
    """Page texts as pages of words: a block a paragraph, no confidence, boxes by line and column."""
    words = F.expr(f"""
      flatten(transform(split(coalesce({text}, ''), '\\n[ \\t\\r]*\\n'), (p, b) ->
        flatten(transform(split(p, '\\r?\\n'), (ln, l) ->
          transform(filter(split(trim(ln), '[ \\t]+'), w -> w != ''), (w, k) -> named_struct(
            'text', w, 'box', named_struct('x0', double(k), 'y0', double(12 * l + 20 * b), 'x1', double(k + 1), 'y1', double(12 * l + 20 * b + 10)),
            'block', b, 'line', b * 10000 + l, 'conf', -1))))))
    """)
    return page_texts.select("source_id", "page_no", words.alias("words"))

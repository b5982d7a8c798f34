"""Language-model scoring of whole documents.

Words of the training documents are counted over all of them.  The most frequent
words, at most ``HEAD``, are broadcast with their counts; a token
outside them meets its count in a join by word.  The most frequent ``EXPLICIT``
words are members of output classes; any other word has a class by its last two
bytes, in which its probability follows its count; one more class is a word that
no training document has.  So the model, like the base, spreads its probability
over the V known words and one unknown word.

Each partition trains a copy of the model on its own share of the training
documents; the copies are averaged, weighted by tokens, in a tree of bounded
fan-in, and the next round begins with the average.  So the model, though not the
base, depends on how the rows are dealt to partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import gated
from keyloom.llm.gated import NEVER, Params, Shape, Tokens, Trainer
from keyloom.llm.text import by_size, crc_mod, one_thread, stable, text_blocks, word_lists

FOLDS = 5
HELD_OUT = 1
HEAD = 1 << 17
EXPLICIT = 2048
MEMBERS = 64
ENDINGS = 96
#: The training documents are dealt to the rounds by hash; each is read in one.
ROUNDS = 2
#: Copies averaged in one task, and levels of the tree: enough for any number of
#: partitions that a job can have, so that one copy reaches the driver.
FAN_IN = 256
LEVELS = 4
#: Tokens counted, looked up or scored, and trained at once.
COUNTED = 3_000_000
BLOCK = 1_500_000
TRAIN_BLOCK = 120_000
#: Share of a word seen once, and of the mean rare word seen once, that stands
#: for words never seen: a count of one tells more of new words than of its own.
NEW = 0.7
#: Counts fall into bins of a 16th of an octave where the head ends.
BINS = 16
END = b""
LN10 = math.log(10)


def ending(word: bytes) -> int:
    """The class of a word by its last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


@cache
def _ending_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of one byte, and of two by their value in big-endian order."""
    return np.array([ending(bytes([i])) for i in range(256)], np.int32), np.array([ending(bytes(divmod(i, 256))) for i in range(1 << 16)], np.int32)


def endings(words: pa.BinaryArray) -> np.ndarray:
    """The class of each word by its last two bytes."""
    _, offsets, data = words.buffers()
    places = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size, last = np.diff(places), places[1:] - 1
    one, two = _ending_tables()
    low = letters[last].astype(np.int32)
    kind = two[letters[last - 1].astype(np.int32) * 256 + low]
    short = np.flatnonzero(size < 2)
    kind[short] = np.where(size[short] == 1, one[low[short]], ending(END))
    return kind


def count_words(texts: DataFrame) -> DataFrame:
    """word (UTF-8), c over all texts (column text); the empty word is a document's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, COUNTED):
            counts = pc.value_counts(word_lists(block.column("text")).flatten().view(pa.binary()))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Head words by rank with their counts, and totals over all training words.

    once: the share of words seen once among tokens outside the head; hapaxes: the
    number of all words seen once.
    """

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    class_mass: np.ndarray
    once: float
    hapaxes: int

    def __post_init__(self) -> None:
        self.known = pa.array(self.words, pa.binary())
        self.explicit = min(EXPLICIT, len(self.words))
        self.classes = EXPLICIT // MEMBERS
        self.ending = endings(self.known)
        # Of each rank, and at the end of a word outside the head: input, class, member and unseen share.
        rank = np.arange(len(self.words) + 1, dtype=np.int32)
        kind = np.append(self.ending, np.int32(0))
        explicit = rank < self.explicit
        self.inputs = np.where(explicit, rank, EXPLICIT + kind)
        self.class_of = np.where(explicit, rank // MEMBERS, self.classes + kind)
        self.member = np.where(explicit, rank % MEMBERS, np.int32(-1))
        self.unseen = np.append(np.where(np.asarray(self.counts) == 1, NEW, 0.0), NEW * self.once).astype(np.float32)
        self.unseen[: self.explicit] = 0

    def __reduce__(self):
        return Lexicon, (self.words, self.counts, self.tokens, self.types, self.class_mass, self.once, self.hapaxes)

    @property
    def shape(self) -> Shape:
        return Shape(EXPLICIT + ENDINGS, self.classes + ENDINGS + 1, self.classes, MEMBERS)

    def start(self) -> Params:
        """Parameters that predict the counts."""
        members = np.full((self.classes, MEMBERS), NEVER)
        places = np.arange(self.explicit)
        members[places // MEMBERS, places % MEMBERS] = np.log(self.counts[: self.explicit])
        mass = np.zeros(self.shape.classes)
        np.add.at(mass, places // MEMBERS, self.counts[: self.explicit].astype(float))
        mass[self.classes : -1] = self.class_mass
        mass[-1] = max(0.5, NEW * self.hapaxes)
        return gated.fresh(self.shape, np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), NEVER), members)

    def read(self, texts: list[str | None] | pa.Array) -> tuple[Tokens, np.ndarray, pa.BinaryArray]:
        """Tokens of the texts, each token's rank (-1: not in the head) and those words."""
        lists = word_lists(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = lists.flatten().view(pa.binary())
        found = pc.index_in(words, value_set=self.known)
        rare = words.filter(found.is_null())
        rank = found.fill_null(-1).to_numpy()
        inputs, classes = self.inputs[rank], self.class_of[rank]
        outside, kind = np.flatnonzero(rank < 0), endings(rare)
        inputs[outside] = EXPLICIT + kind
        classes[outside] = self.classes + kind
        first = np.zeros(len(rank), bool)
        first[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()] = True
        return Tokens(inputs, classes, self.member[rank], self.unseen[rank], first), rank, rare


def binned(count: Column) -> Column:
    """The bin of a count; single counts while they are small."""
    return F.floor(F.log2(count) * BINS).cast("int")


def lexicon(counts: DataFrame, head: int = HEAD) -> tuple[Lexicon, int | None]:
    """The lexicon of counted words, and the least bin of the head (None: all words).

    The head is all words of the highest bins of counts that hold at most ``head``
    words.  Only they, a row a bin and a row a class come to the driver.
    """
    least, held = None, 0
    for r in sorted(counts.groupBy(binned(F.col("c")).alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > head:
            break
        least = r.bin
    else:
        least = None if held <= head else least
    whole = held <= head
    kept = counts if whole else counts.where(binned(F.col("c")) >= (least if least is not None else 1 << 20))
    top = sorted(((bytes(r.word), r.c) for r in kept.collect()), key=lambda x: (-x[1], x[0]))
    kind = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(ENDINGS))
    sums = counts.groupBy(kind.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).collect()
    mass = np.zeros(ENDINGS)
    for r in sums:
        mass[r.kind] = r.c + 0.5 * r.n
    for w, c in top[:EXPLICIT]:
        mass[ending(w)] -= c + 0.5
    tokens, types, once = (sum(x) for x in zip(*((r.c, r.n, r.once) for r in sums), strict=True)) if sums else (0, 0, 0)
    outside = tokens - sum(c for _, c in top)
    rare = once - sum(c == 1 for _, c in top)
    words = Lexicon([w for w, _ in top], np.array([c for _, c in top], np.int64), tokens, types, np.maximum(mass, 0), rare / outside if outside else 0.0, once)
    return words, None if whole else least if least is not None else 1 << 20


def _averaged(copies: DataFrame, fan_in: int) -> DataFrame:
    """Copies averaged in groups of at most ``fan_in``, weighted by their tokens."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        weight = frame["tokens"].to_numpy()
        total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weight, frame["params"], strict=True))
        return pd.DataFrame({"part": [frame["part"].iloc[0] // fan_in], "tokens": [weight.sum()], "params": [(total / weight.sum()).astype(np.float32).tobytes()]})

    return copies.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(mean, "part long, tokens double, params binary")


def train(texts: DataFrame, words: Lexicon, rounds: int = ROUNDS) -> Params:
    """The model after one pass over all texts (doc_id, text), dealt to ``rounds`` rounds."""
    params = words.start()
    spark = texts.sparkSession
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((words, gated.flat(params)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            one_thread()
            lexicon_, start = shared.value
            trainer = Trainer(gated.unflat(start, lexicon_.start()))
            read = 0
            for blocks in by_size(text_blocks(batches, TRAIN_BLOCK), lambda b: b.column("text").nbytes // 5 + b.num_rows, BLOCK):
                tokens = lexicon_.read(pa.concat_batches(blocks).column("text"))[0]
                docs = np.append(np.flatnonzero(tokens.first), len(tokens.first))
                cuts = docs[np.cumsum([0, *(b.num_rows for b in blocks)])].tolist()
                for start, end in zip(cuts, cuts[1:], strict=False):
                    read += trainer.learn(tokens.part(start, end))
            if read:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "tokens": [float(read)], "params": [gated.flat(trainer.p).tobytes()]})

        share = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == number).select("text")
        copies = share.mapInArrow(run, "part long, tokens double, params binary")
        for _ in range(LEVELS):
            copies = _averaged(copies, FAN_IN)
        row = copies.first()
        if row:
            params = gated.unflat(np.frombuffer(row.params, np.float32), params)
        shared.unpersist()
    return params


#: Scores of a document's head tokens, or of one of its words outside the head: then
#: key is the word, own and other the logs if it is known and if not, and head is null.
SCORED = "key binary, row long, own double, other double, head struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double>"
HEAD_OF = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64()}


def _scored(rows: DataFrame, words: Lexicon, params: Params) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((words, gated.flat(params)))
    names = ["key", "row", "own", "other", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        lexicon_, values = shared.value
        p = gated.unflat(values, lexicon_.start())
        # Of each rank, and at the end of a word outside the head, which counts for nothing here.
        log_count = np.append(np.log10(lexicon_.counts + 0.5), 0.0)
        mass = np.append(lexicon_.class_mass[lexicon_.ending], 1.0)
        inner = np.where(np.arange(len(log_count)) < lexicon_.explicit, 0.0, log_count - np.log10(np.maximum(mass, 0.5)))
        inner[-1] = 0
        for block in text_blocks(batches, BLOCK):
            tokens, rank, rare = lexicon_.read(block.column("text"))
            own, other = gated.log_probabilities(p, tokens)
            own /= LN10
            starts = np.flatnonzero(tokens.first)
            sizes = np.diff(np.append(starts, len(rank)))
            outside = np.flatnonzero(rank < 0)
            n, rows = len(outside), block.num_rows
            rare_own, rare_other = own[outside], other[outside] / LN10
            own += inner[rank]
            own[outside] = 0
            head = [
                block.column("doc_id").cast(pa.int64()),
                block.column("held_out"),
                pa.array(sizes),
                pa.array(np.add.reduceat((rank >= 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(log_count[rank], starts)),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b"\n%d" % r for r in block.column("row").to_pylist()], pa.binary()),
                    block.column("row"),
                    pa.array(np.add.reduceat(own, starts)),
                    pa.array(np.zeros(rows)),
                    pa.StructArray.from_arrays(head, list(HEAD_OF)),
                ],
                names,
            )
            if n:
                row = pa.array(np.repeat(block.column("row").to_numpy(), sizes)[outside])
                yield pa.RecordBatch.from_arrays([rare, row, pa.array(rare_own), pa.array(rare_other), pa.nulls(n, pa.struct(HEAD_OF))], names)

    return rows.mapInArrow(run, SCORED)


def lm_score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Log-likelihoods of the whole text of each row of ``docs``.

    Needs doc_id and text; other columns are ignored, whatever their names.  Rows
    whose crc32 of the decimal doc_id leaves 1 modulo 5 are held out: nothing is
    counted or learned from them.  A null text is empty and has the end as its
    only token; a null id counts as the text ''.  Repeated rows each get a row and
    each count.  Without training rows every token is unknown, and unknown words
    have probability one under base and model.  An empty table gives none.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score;
    scores are sums of log10 over the tokens.
    """
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    training = rows.where(~F.col("held_out"))
    counts = stable(count_words(training))
    words, least = lexicon(counts, head)
    params = train(training, words, rounds)
    counts = counts.where(F.lit(False) if least is None else binned(F.col("c")) < least)
    kind = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(ENDINGS))
    masses = F.array(*[F.lit(float(max(m, 0.5))) for m in words.class_mass])
    rare = counts.select(F.col("word").alias("key"), F.col("c"), F.log10(masses[kind]).alias("mass"))
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    known, outside = F.col("c").isNotNull(), F.col("head").isNull()
    own = F.when(~outside, F.col("own")).when(known, F.col("own") + log_count - F.col("mass")).otherwise(F.col("other"))
    met = _scored(rows, words, params).join(rare, "key", "left")
    sums = met.groupBy("row").agg(
        F.max("head.doc_id").alias("doc_id"),
        F.max("head.held_out").alias("held_out"),
        F.sum("head.n_tokens").alias("n_tokens"),
        F.sum(F.when(outside, F.when(known, 1).otherwise(0)).otherwise(F.col("head.n_known"))).alias("n_known"),
        F.sum(F.when(outside, log_count).otherwise(F.col("head.base"))).alias("base"),
        F.sum(own).alias("score"),
    )
    total = math.log10(words.tokens + 0.5 * (words.types + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score")

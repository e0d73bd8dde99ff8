"""Language identification by cross-parsing against suffix automata.

For every language a bounded sample of labelled text gives a suffix automaton.
A text is parsed greedily into phrases, each the longest piece that occurs in
the language's sample; the language that needs the fewest phrases, normalised
for the size of its sample, is the prediction. All texts of a slice walk the
automata side by side with numpy: texts are dealt into lanes of LANE letters,
a lane goes on from the state in which the one before it ends, and a state's row
in the transition table already holds the restart after a phrase.

Letters are folded to lower case; runs of everything else are one separator.
Every letter of the samples has its own code. In each automaton the ALPHABET most
frequent letters of its language have a column in the table, and moves by the
others are looked up in a sorted list. Letters that no sample holds match
nothing, so each is a phrase.

Languages of many letters need more phrases for their own texts too. So a
language's limit for foreign texts is FOREIGN, or SPREAD times what the second
half of its sample needs over the first, if that is more.

The sample: all labelled texts are cut into pieces of PIECE characters from end
to end; for each language and each of BUCKETS buckets the piece of the least
hash is learned, if there is one that is full, else of a shorter one. So at
most BUCKETS * PIECE letters a language are learned, however large the table is;
predictions read whole texts.

Defined results: null texts and texts without a letter are `und` with score 0.
Rows without a language or doc_id are not learned from. Without any learned
language every text is `und`, and a filter keeps all that have letters. Ties go to the language first in order. Of
repeated doc_ids the least piece is learned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import text as X

BUCKETS, PIECE = 48, 400
LANE = 512
#: Bytes of text that are parsed at once.
SLICE = 1 << 20
#: Letters of a language that have a column in its table.
ALPHABET = 94
UNKNOWN = "und"
#: Phrases after the first per letter, in the best language, from which a text counts as written in none of them.
FOREIGN = 0.55
SPREAD = 1.25


def _fold_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; 0 for the rest."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c <= 0xDFFF and (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return table


_fold: np.ndarray | None = None


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts (0: a run of other characters between letters, one at most), and offsets."""
    global _fold
    if _fold is None:
        _fold = _fold_table()
    wide = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=at[1:])
    code = _fold[np.minimum(wide, 0xFFFF)]
    if len(wide) and (far := np.flatnonzero(wide > 0xFFFF)).size:
        code[far] = [int(c) if chr(int(c)).isalpha() else 0 for c in wide[far]]
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    first = at[:-1][np.diff(at) > 0]
    keep[first] = code[first] != 0
    total = np.zeros(len(wide) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return code[keep], total[at]


class Automaton:
    """The suffix automaton of a sequence of codes, as moves from state to state.

    A move is 4 * (next state) and how many phrases ended: none if the code goes
    on with the phrase, one if a new phrase begins with it; a code that stands
    nowhere is a phrase by itself, beside the one it ends. moves[state * width +
    column] has those of the frequent codes; keys and targets have those of the
    others that go on with a phrase, and restart those that begin one.
    """

    def __init__(self, sequence: np.ndarray, many: int):
        own, counts = np.unique(sequence[sequence > 1], return_counts=True)
        own = own[np.lexsort((own, -counts))]
        #: The column of each of `many` codes; 0 separator, 1 codes that stand nowhere.
        self.column = np.ones(many, np.int64)
        self.column[0] = 0
        self.column[own] = np.arange(len(own)) + 2
        self.width, self.span = min(len(own), ALPHABET) + 2, len(own) + 2
        codes = self.column[sequence].tolist()
        link, size, out = [-1], [0], [{}]
        last = 0
        for c in codes:
            new = len(link)
            link.append(0)
            size.append(size[last] + 1)
            out.append({})
            p = last
            while p != -1 and c not in out[p]:
                out[p][c] = new
                p = link[p]
            if p != -1:
                q = out[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(link)
                    link.append(link[q])
                    size.append(size[p] + 1)
                    out.append(dict(out[q]))
                    while p != -1 and out[p].get(c) == q:
                        out[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        table = np.full((len(out), self.width), 2, np.int32)
        table[0] = 1
        for c, q in out[0].items():
            if c < self.width:
                table[1:, c] = 4 * q + 1
        far = []
        for s, moves in enumerate(out):
            for c, q in moves.items():
                if c < self.width:
                    table[s, c] = 4 * q
                else:
                    far.append((s * self.span + c, 4 * q))
        self.moves = table.ravel()
        self.keys, self.targets = np.array(sorted(far), np.int64).reshape(-1, 2).T.copy()
        self.restart = np.array([4 * out[0][c] + 1 for c in range(self.width, self.span)], np.int64)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        column = self.column[codes]
        if not len(self.keys):
            return self.moves[state * self.width + column]
        move = self.moves[state * self.width + np.minimum(column, self.width - 1)].astype(np.int64)
        far = np.flatnonzero(column >= self.width)
        wanted = state[far] * self.span + column[far]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        move[far] = np.where(self.keys[at] == wanted, self.targets[at], self.restart[column[far] - self.width])
        return move


class Lanes:
    """Texts dealt into lanes of LANE letters, which all walk an automaton at once."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        lanes = -(-size // LANE)
        first = np.cumsum(lanes) - lanes
        owner = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(owner)) - np.repeat(first, lanes)
        start = at[:-1][owner] + LANE * nth
        length = np.minimum(LANE, at[1:][owner] - start)
        # long lanes first, so that those which still walk stand together
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.texts, self.owner, self.length = len(size), owner[order], length[order]
        #: The lane that goes on before each, or -1; whether a lane ends its text.
        self.before = np.where(nth > 0, place[np.maximum(np.arange(len(owner)) - 1, 0)], -1)[order] if len(owner) else owner
        self.last = (nth == lanes[owner] - 1)[order]
        self.active = np.searchsorted(-self.length, -np.arange(1, LANE + 1), "right")
        # the k-th code of every lane stands together
        start = start[order]
        self.columns = [codes[start[: self.active[k]] + k] for k in range(int(self.length[0]) if len(order) else 0)]

    def phrases(self, automaton: Automaton) -> np.ndarray:
        """Phrases of each text, of a walk that goes on from lane to lane.

        First every lane walks from the beginning of a phrase. Then lanes walk
        again from where the lane before them came to, until they are where they
        were the first time, which they soon are. Should one not be so at its
        end, the lane behind it walks once more.
        """
        lanes = len(self.owner)
        entered, state, ended = np.zeros((3, lanes), np.int64)
        walked = []
        for column in self.columns:
            many = len(column)
            move = automaton.step(state[:many], column)
            ended[:many] += move & 3
            state[:many] = move >> 2
            walked.append(move)
        follows = np.flatnonzero(self.before >= 0)
        while len(again := follows[state[self.before[follows]] != entered[follows]]):
            now = state[self.before[again]]
            entered[again] = now
            for k, column in enumerate(self.columns):
                # a lane that another one follows is full, so only a text's last lane can end here
                open_ = k < self.length[again]
                again, now = again[open_], now[open_]
                if not len(again):
                    break
                move, old = automaton.step(now, column[again]), walked[k][again]
                walked[k][again] = move
                ended[again] += (move & 3).astype(np.int64) - (old & 3)
                now = move.astype(np.int64) >> 2
                state[again[k + 1 == self.length[again]]] = now[k + 1 == self.length[again]]
                apart = now != old >> 2
                again, now = again[apart], now[apart]
        return np.bincount(self.owner, ended + (self.last & (state > 0)), self.texts).astype(np.int64)


class Model:
    def __init__(self, samples: dict[str, np.ndarray]):
        every = np.concatenate([*samples.values(), np.zeros(0, np.uint32)])
        #: Codes: 0 separator, 1 any letter that no sample holds, then these.
        self.known = np.unique(every[every > 0])
        self.languages = sorted(samples)
        own = [self.codes(samples[k]) for k in self.languages]
        self.automata = [Automaton(codes, len(self.known) + 2) for codes in own]
        #: The most phrases per letter of a text in each language, if that is over FOREIGN.
        self.limits = {k: self.limit(codes) for k, codes in zip(self.languages, own)}
        # an unrelated text of n letters over a sample of N has about n / log N phrases
        self.norm = np.array([np.log(max(len(samples[k]), 2)) for k in self.languages])
        self.norm = self.norm / self.norm.max() if len(self.norm) else self.norm

    def codes(self, folded: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return (folded > 0).astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, folded), len(self.known) - 1)
        return np.where(folded == 0, 0, np.where(self.known[at] == folded, at + 2, 1))

    def limit(self, codes: np.ndarray) -> float:
        """SPREAD times the phrases per letter that the second half needs over the first, brought to the size of the whole."""
        half = len(codes) // 2
        lanes = (len(codes) - half) // PIECE
        if half < 2 or not lanes:
            return FOREIGN
        automaton = Automaton(codes[:half], len(self.known) + 2)
        state, ended = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        for column in codes[half : half + lanes * PIECE].reshape(lanes, PIECE).T:
            move = automaton.step(state, column)
            ended += move & 3
            state = move.astype(np.int64) >> 2
        return max(FOREIGN, SPREAD * float(np.median(ended)) / PIECE * float(np.log(half) / np.log(len(codes))))

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters per text, and phrases per text and language."""
        folded, at = letters(texts)
        codes = self.codes(folded)
        size = np.diff(at)
        lanes = Lanes(codes, at)
        out = np.zeros((len(size), len(self.automata)), np.int64)
        for n, automaton in enumerate(self.automata):
            out[:, n] = lanes.phrases(automaton)
        return size, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases after the first per letter of each text."""
        size, phrases = self.phrases(texts)
        folded_letters = size > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.where(folded_letters, 0.0, np.inf)
        need = phrases * self.norm
        best = need.argmin(axis=1)
        rows = np.arange(len(texts))
        least = need[rows, best]
        others = need.copy()
        others[rows, best] = np.inf
        second = others.min(axis=1) if len(self.languages) > 1 else 2 * least
        margin = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0)
        score = np.where(folded_letters, 0.5 + 0.5 * margin, 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, folded_letters)]
        return names, np.clip(score, 0, 1), np.where(folded_letters, (phrases[rows, best] - 1) / np.maximum(size, 1), np.inf)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", buckets: int = BUCKETS, piece: int = PIECE) -> Model:
    """Learn from the rows given; at most buckets * piece letters for each language."""
    own = docs.select(docs[key].alias("key"), docs[lang].alias("lang"), docs[text].alias("text"))
    own = own.filter(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    # every piece of every text can be drawn, wherever it stands; pieces that are filled come before a text's short last one
    pieces = own.withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))))
    short = (F.length("text") < (F.col("nth") + 1) * piece).cast("int")
    hashed = F.xxhash64("key", "nth", F.lit("language"))
    pieces = pieces.select("key", "lang", "nth", F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket"), F.struct(short.alias("short"), hashed.alias("hash")).alias("rank"))
    chosen = pieces.groupBy("lang", "bucket").agg(F.min(F.struct("rank", "key", "nth")).alias("least")).select("lang", "bucket", "least.key", "least.nth")
    # one row for each language and bucket: the languages are the classes, a bounded number
    found = own.join(F.broadcast(chosen), ["lang", "key"])
    picked = found.groupBy("lang", "bucket").agg(F.min(F.substring("text", F.col("nth") * piece + 1, F.lit(piece))).alias("text")).orderBy("lang", "bucket").collect()
    samples: dict[str, list[np.ndarray]] = {}
    for r in picked:
        folded, _ = letters([r["text"]])
        samples.setdefault(r["lang"], []).append(np.append(folded, 0).astype(np.uint32))
    return Model({k: np.concatenate(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, lang_pred, score (0 to 1) and phrases per letter in that language."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text", SLICE):
            names, score, rate = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["key", "lang_pred", "score", "rate"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, lang_pred string, score double, rate double")


def keep_written(docs: DataFrame, model: Model, text: str = "text", foreign: float = FOREIGN) -> DataFrame:
    """The documents written in a learned language; texts without letters go, and those that need more than `foreign` phrases per letter, or than the language's own limit if that is higher."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text, SLICE):
            names, _, rate = held.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            limit = np.array([max(foreign, held.value.limits.get(k, foreign)) for k in names])
            yield batch.filter(pa.array(rate <= limit))

    return docs.mapInArrow(run, docs.schema)


def op10_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, fit(docs.filter(fold != 2))).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

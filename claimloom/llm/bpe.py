"""BPE encoding and decoding by prefix-sharing trie traversal.

In BPE the encoding of a prefix of a word ends in one *last token*, and the encoding before that token is the
encoding of the shorter prefix. So a trie node needs one state, its last token: of the vocabulary's tokens that end
at the node it is the one that can stand after the last token of the node it starts from. Distinct words of a batch
are put into a trie, walked depth first, and each shared prefix is worked out once. The last symbol of a word
carries the end-of-word mark, so the words themselves are the trie's leaves.

Documents never move: the work is one pass over each partition, with a bounded table of words already encoded.

Defined results: a null or empty text has no tokens and decodes to the empty text; the strings of special tokens
in a text are special tokens; repeated rows are encoded each; a very long text is cut into words, never cut short;
extra columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, released

#: White_Space of Unicode, as regular expressions of the tokenizer's kind see it.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Encoded words, and runs of a generation, kept during a task; answers of ``fits``; bytes of output in a batch.
KEPT_RUNS, KEPT_FITS, OUT_BYTES = 300_000, 1 << 19, 16 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary read from a tokenizer file (its own JSON form)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end = model["end_of_word_suffix"]
        self.names: dict[int, str] = {i: name for name, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: name for name, i in self.special.items()}
        symbols = byte_symbols()
        #: A symbol is a byte, plus 256 if the word ends with it; a token is keyed by its symbols as text.
        first = {s: chr(b) for b, s in enumerate(symbols)}
        self.ids: dict[str, int] = {}
        for name, i in model["vocab"].items():
            last = name.endswith(end) and len(name) > len(end)
            key = [first[c] for c in (name[: -len(end)] if last else name)]
            if last:
                key[-1] = chr(ord(key[-1]) + 256)
            self.ids["".join(key)] = i
        #: All beginnings of tokens, and the automaton over them that is unfolded as words are walked: a node is the
        #: longest beginning that ends here; "" holds the tokens that end here, longest first.
        self.beginnings = {key[:n] for key in self.ids for n in range(1, len(key) + 1)}
        self.fitting: dict[int, dict[int, bool]] = {}
        self.n_fitting = 0
        self.nodes: dict[str, dict] = {}
        self.root = self._node("")
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        #: Rank of each merge; what each merged token was merged from.
        self.rank, self.parts = {}, {}
        for rank, (a, b) in enumerate(pairs):
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank.setdefault((left, right), (rank, made))
            self.parts.setdefault(made, (rank, left, right))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.space = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\\x1c-\\x1f]")  # white space to str.split() alone
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        #: Names by id, for ids as dense as a vocabulary's are; "" where an id has none (no token's name is empty).
        self.by_id = [self.names.get(i, "") for i in range(max(self.names, default=-1) + 1)]
        #: Packed ids of encoded words, and of runs of two generations.
        self.known: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _node(self, text: str) -> dict:
        found = self.nodes.get(text)
        if found is None:
            ends = [(self.ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.ids]
            found = self.nodes[text] = {"": [(token, n, self.fitting.setdefault(token, {})) for token, n in ends], None: text}
        return found

    def _follow(self, node: dict, c: str) -> dict:
        """The node after ``node`` and ``c``, remembered there."""
        text = node[None] + c
        while text and text not in self.beginnings:
            text = text[1:]
        found = node[c] = self._node(text)
        return found

    def _fit(self, left: int, token: int) -> bool:
        """``fits``, remembered with the token; at most ``KEPT_FITS`` answers are kept."""
        if self.n_fitting >= KEPT_FITS:
            for x in self.fitting.values():
                x.clear()
            self.n_fitting = 0
        self.n_fitting += 1
        good = self.fitting[token][left] = self.fits(left, token)
        return good

    def fits(self, left: int, right: int) -> bool:
        """Whether merging never joins anything across the border of these two tokens.

        Undo the later merge of the two again and again; the border holds unless, on the way, a merge of the two
        neighbours at the border would have come before the merge that is being undone.
        """
        limit = 1 << 60
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined[0] < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:  # merges of one rank go from left to right: one at the border would come first, and on a tie the right one is undone first
                limit, right = b[0] + 1, b[1]

    def encode_words(self, words) -> None:
        """Put distinct words into ``known``. In sorted order they are the trie in preorder; the lists are the path."""
        other = {word.encode("utf-8", "surrogatepass").decode("latin-1"): word for word in words if not word.isascii()}
        keys = [word for word in words if word.isascii()]
        keys += other
        keys.sort()
        packed, known, follow, fit = self.packed, self.known, self._follow, self._fit
        #: The path from the trie's root: place in the automaton, last token, packed encoding up to here.
        here, path = self.root, ""
        state = [(here, -1, b"")]
        for key in keys:
            body = key[:-1]
            shared = len(path)
            if not body.startswith(path):
                shared = 0
                for x, y in zip(path, body):
                    if x != y:
                        break
                    shared += 1
                del state[shared + 1 :]
                here = state[shared][0]
            path = body
            depth = shared
            for c in body[shared:]:
                depth += 1
                try:
                    here = here[c]
                except KeyError:
                    here = follow(here, c)
                for token, n, fitting in here[""]:
                    _, left, before = state[depth - n]
                    if left < 0:
                        break
                    good = fitting.get(left)
                    if good or (good is None and fit(left, token)):
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
                state.append((here, token, before + packed[token]))
            c = chr(ord(key[-1]) + 256)
            depth += 1
            for token, n, fitting in (here.get(c) or follow(here, c))[""]:
                _, left, before = state[depth - n]
                if left < 0:
                    break
                good = fitting.get(left)
                if good or (good is None and fit(left, token)):
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            known[other.get(key, key)] = before + packed[token]

    def runs(self, text: str) -> list[str]:
        """The text cut at white space; strings of special tokens stay whole.

        Neither normalisation nor words cross white space, so a run is encoded on its own, and once.
        """
        out: list[str] = []
        for k, part in enumerate(self.split.split(text) if "<" in text and self.split else [text]):
            if k % 2:
                out.append(part)
            elif self.odd.search(part):
                out += [x for x in self.space.split(part) if x]
            else:
                out += part.split()
        return out

    def pieces(self, run: str) -> list[str]:
        """The words of a run, normalised."""
        if run.isascii():  # most are one word, or one and a mark
            if run.isalpha():
                return [run.lower()]
            if run[:-1].isalpha() and not run[-1].isdigit():
                return [run[:-1].lower(), run[-1]]
        if run in self.special:
            return [run]
        return self.words.findall((run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")).lower())

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.seen) > KEPT_RUNS:  # the generation before last is forgotten
            self.before, self.seen = self.seen, {}
        if len(self.known) > KEPT_RUNS:
            self.known.clear()
        for name, i in self.special.items():
            self.known[name] = self.packed[i]
        seen, known = self.seen, self.known
        out: list = []
        late: list[tuple[int, list, list[str], list[int]]] = []
        new: set[str] = set()
        for text in texts:
            runs = self.runs(text)
            got = list(map(seen.get, runs))
            if None in got:
                missing = [k for k, x in enumerate(got) if x is None]
                new.update([runs[k] for k in missing])
                late.append((len(out), got, runs, missing))
                out.append(None)
            else:
                out.append(b"".join(got))
        old = new.intersection(self.before)
        seen.update((x, self.before[x]) for x in old)
        new.difference_update(old)
        made = {run: self.pieces(run) for run in new}
        words: set[str] = set()
        for x in made.values():
            words.update(x)
        words.difference_update(known)
        self.encode_words(words)
        for run, x in made.items():  # a run of characters that normalise to nothing has no words
            seen[run] = known[x[0]] if len(x) == 1 else b"".join([known[w] for w in x])
        for at, got, runs, missing in late:
            for k in missing:
                got[k] = seen[runs[k]]
            out[at] = b"".join(got)
        return out

    def forget(self) -> None:
        """Let go of what was encoded: workers outlive their task, and other stages need the memory."""
        self.known.clear()
        self.seen, self.before = {}, {}
        for x in self.fitting.values():
            x.clear()
        self.n_fitting = 0

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: names of tokens, spaces between, ids without a name left out."""
        names = self.by_id
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and int(ids.max()) >= len(names):
            ids = ids[ids < len(names)]
        got = list(map(names.__getitem__, ids.tolist()))
        return " ".join(filter(None, got) if "" in got else got)


@lru_cache(maxsize=4)
def parsed(spec: str) -> Vocabulary:
    return Vocabulary(json.loads(spec))


def _groups(batch, texts):
    """Row ranges whose texts have about OUT_BYTES / 4 characters."""
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size > OUT_BYTES // 4:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``keep``, then n_tokens long and ids (packed little-endian uint32).

    The tokenizer file (a few MB of JSON, its size fixed by the vocabulary) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keep = keep or {}
    kept_names = list(keep)
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))

    def work(batches):
        vocabulary = parsed(shared.value)
        gc.disable()  # nothing here is cyclic, and walking all that is kept again and again costs a sixth of the time
        for batch in batches:
            texts = [x or "" for x in batch["_text"].to_pylist()]
            for a, b in _groups(batch, texts):
                got = vocabulary.encode_texts(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*[batch[k].slice(a, b - a) for k in kept_names], pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary())],
                    [*kept_names, "n_tokens", "ids"],
                )
        gc.enable()
        vocabulary.forget()
        released()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return rows.mapInArrow(work, T.StructType([*rows.drop("_text").schema.fields, *fields]))


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``keep``, then the decoded text of packed ids."""
    spark = encoded.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keep = keep or {}
    kept_names = list(keep)
    rows = encoded.select(*[c.alias(k) for k, c in keep.items()], F.col(ids_col).alias("_ids"))

    def work(batches):
        vocabulary = parsed(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept_names], pa.array([vocabulary.decode(x or b"") for x in batch["_ids"].to_pylist()], pa.string())], [*kept_names, "decoded"])

    return rows.mapInArrow(work, T.StructType([*rows.drop("_ids").schema.fields, T.StructField("decoded", T.StringType())]))

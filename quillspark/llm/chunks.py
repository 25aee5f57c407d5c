"""Exact chunk tables for the two tokenizers: each distinct chunk is encoded once per worker and then joined back by position."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A table is emptied beyond this many chunks (of byte pairs) or words (of pieces), and longer chunks are not kept: only memory is bounded, never what is encoded.
MOST_CHUNKS, MOST_WORDS, LONGEST_KEPT = 500_000, 400_000, 64

#: White space as the pre-tokenizer's expression sees it, without the space and the line break.
_OTHER = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(f"[ \n{_OTHER}]?[^ \n{_OTHER}]+|[ \n{_OTHER}]+(?![^ \n{_OTHER}])")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_tables: dict = {}


def space_chunks(text: str) -> list[str]:
    """Keys of the chunks of ``text``, cut where the byte-level BPE's pre-tokenizer always cuts.

    It cuts before white space that follows something else, and before the last
    character of a run of white space that something follows.  A key that
    starts with a line break is the chunk itself, one that starts with two
    spaces has it behind them, and any other is a chunk without its first space.
    """
    if not text:
        return []
    if text[-1] not in " \n" and not any(c in text for c in _OTHER) and not any(c in text for c in _RUNS):
        keys = text.replace("\n", " \n").split(" ")
        if keys[0]:
            keys[0] = "  " + keys[0]
            return keys
        return keys[1:]
    out = []
    for c in _WORDS.findall(text):
        if c[0] == " " and len(c) > 1 and c[1] not in " \n" and c[1] not in _OTHER:
            out.append(c[1:])
        else:
            out.append(c if c[0] == "\n" else "  " + c)
    return out


#: Latin letters, and marks of ASCII: the pre-tokenizer cuts a word of letters with marks behind them into these two.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-/:-@\\[-`{-~"
_LETTER, _MARK = ["".join([chr(c) for c in range(0x21, 0x250) if re.match(f"[{x}]", chr(c))]) for x in (_LETTERS, _MARKS)]
_WORD, _MARKED = f"^(  )?[{_LETTERS}]+$", f"^(\n|  )?[{_LETTERS}]+[{_MARKS}]*$"
#: Texts in which spaces and line breaks stand alone between words are split by Arrow, others by ``space_chunks``.
_UNEVEN = f"^$|^[ \n]|  | \n|\n |\n\n|[ \n]$|[{_OTHER}]"


def alphabet() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table (all ids one after another, lengths) in the order of ``codes``, as such a table."""
    ids, lengths = table
    counts = lengths[codes]
    after = np.cumsum(counts)
    at = np.repeat((np.cumsum(lengths) - lengths)[codes] - after + counts, counts)
    at += np.arange(len(at))
    return ids[at], counts


def join_ids(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The table's entries put together in the order of ``codes``, cut after each number of codes in ``ends``."""
    ids, counts = gather(table, codes)
    cuts, raw = (4 * np.r_[0, np.cumsum(counts)])[np.r_[0, ends]].tolist(), ids.tobytes()
    return [raw[i:j] for i, j in zip(cuts, cuts[1:])]


class BytePairs:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    Arrow splits the texts and numbers the distinct chunks.  Words are cut into
    letters and the marks behind them, numbered again, and those that the table
    doesn't hold yet are encoded; ids are put together by number.  Letters go to
    the library in its own alphabet, a line break between words, which no merge
    crosses; all else goes through its whole chain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        line = self.lib.encode("\n", add_special_tokens=False).ids
        if len(line) != 1:
            raise ValueError("chunks are told apart by the line break, which this vocabulary has no id for")
        self.line = line[0]
        # around the strings of added tokens the library cuts otherwise: texts with one go to it whole
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        written = np.array(sorted(alphabet(), key=alphabet().get))
        self.written = written.view("<u4").astype("<u2")
        cuts = [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(f"ab, c\n{_LETTER}{_MARK}")]
        self.plain = self.lib.normalizer is None and cuts == ["ab", ",", "\u0120c", "\u010a", self._write(_LETTER), _MARK]
        self.words = Tokenizer.from_file(path)
        # words are told apart by merges alone where no entry holds a line break beside what words consist of
        own, model = set(self._write(f"{_LETTER} \n")), self.words.model
        crossing = any("\u010a" in t and t.strip("\u010a") and own.issuperset(t) for t in self.lib.get_vocab(with_added_tokens=False))
        bent = model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix
        self.words.pre_tokenizer = pre_tokenizers.Split("\u010a", "isolated") if crossing or bent else None

    @classmethod
    def of(cls, path: str) -> "BytePairs":
        """The one of this worker, which later tasks find filled."""
        if ("bpe", path) not in _tables:
            _tables["bpe", path] = cls(path)
        return _tables["bpe", path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _write(self, text: str) -> str:
        return self.written[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def _learn_words(self, keys: list[str]) -> None:
        """Runs of letters, which stand behind a space unless their key starts with two."""
        for i in range(0, len(keys), 128):
            part = keys[i : i + 128]
            text = self._write("\n".join([k[2:] if k[0] == " " else " " + k for k in part]))
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = (4 * np.flatnonzero(ids == self.line)).tolist(), ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]))

    def _learn(self, new: list[str]) -> None:
        letters = pc.match_substring_regex(pa.array(new, pa.string()), _WORD).to_numpy(zero_copy_only=False).tolist() if self.plain else [False] * len(new)
        self._learn_words([k for k, own in zip(new, letters) if own])
        other = [k for k, own in zip(new, letters) if not own]
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            self.known.update(zip(part, self._ids([c if c[0] == "\n" else c[2:] if c[0] == " " else " " + c for c in part])))

    def _entries(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The table of distinct keys that are encoded as they are."""
        known = self.known
        if len(known) > MOST_CHUNKS:
            known.clear()
        new = [k for k in keys if k not in known]
        self._learn(new)
        out = [known[k] for k in keys]
        for k in new:
            if len(k) > LONGEST_KEPT:
                known.pop(k, None)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) >> 2

    def _table(self, keys: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The table of distinct chunks: a line break and the marks behind a word's letters are entries of their own."""
        keys = keys if isinstance(keys, pa.Array) else pa.array(keys, pa.string())
        bare = pc.ascii_rtrim(keys, _MARK)
        line = pc.starts_with(keys, "\n").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(line | (pc.binary_length(keys).to_numpy() > pc.binary_length(bare).to_numpy()))
        if not len(cut) or not self.plain:
            return self._entries(keys.to_numpy(zero_copy_only=False).tolist())
        cut = cut[pc.match_substring_regex(keys.take(pa.array(cut)), _MARKED).to_numpy(zero_copy_only=False)]
        own, whole = keys.take(pa.array(cut)), np.ones(len(keys), bool)
        whole[cut] = False
        stems = pc.replace_substring(bare.take(pa.array(cut)), "\n", "  ")
        marks = pc.binary_join_element_wise(pa.scalar("  ", keys.type), pc.utf8_ltrim(own, f"\n {_LETTER}"), pa.scalar("", keys.type))
        # the entry of two spaces is empty
        every = pa.concat_arrays([keys.filter(pa.array(whole)), stems, marks, pa.array(["\n", "  "], keys.type)]).dictionary_encode()
        code, n = every.indices.to_numpy().astype(np.int64), len(keys)
        parts = np.full((n, 3), code[-1])
        parts[whole, 1], parts[cut, 1], parts[cut, 2] = np.split(code[:-2], [n - len(cut), n])
        parts[line & ~whole, 0] = code[-2]
        ids, counts = gather(self._entries(every.dictionary.to_numpy(zero_copy_only=False).tolist()), parts.ravel())
        return ids, counts.reshape(n, 3).sum(1)

    def _spaced_out(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that ``space_chunks`` cuts, which share their distinct chunks."""
        place: dict[str, int] = {}
        codes, ends = array("q"), [0]
        for t in texts:
            codes.extend([place.setdefault(k, len(place)) for k in (["  " + t] if any(a in t for a in self.added) else space_chunks(t))])
            ends.append(len(codes))
        return join_ids(self._table(list(place)), np.array(codes, np.int64), np.array(ends[1:], np.int64))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for a in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, a))
        out: list = [None] * len(texts)
        even = np.flatnonzero(~uneven.to_numpy(zero_copy_only=False))
        if len(even):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
            chunks, ends = lists.flatten().dictionary_encode(), np.cumsum(lists.value_lengths().to_numpy())
            codes, names = chunks.indices.to_numpy().astype(np.int64), chunks.dictionary
            # the first chunk of a text has no space before it
            first: dict[str, int] = {}
            starts = np.r_[0, ends[:-1]]
            codes[starts] = [first.setdefault(c if c[0] == "\n" else "  " + c, len(names) + len(first)) for c in names.take(pa.array(codes[starts])).to_pylist()]
            table = self._table(pa.concat_arrays([names, pa.array(list(first), names.type)]))
            for i, ids in zip(even.tolist(), join_ids(table, codes, ends)):
                out[i] = ids
        rest = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        for i, ids in zip(rest.tolist(), self._spaced_out(texts.take(pa.array(rest)).to_pylist())):
            out[i] = ids
        return out


class Pieces:
    """A SentencePiece model whose pieces hold the white-space marker only at their start, or are runs of it.

    A normalised text then falls into marked words (one or more markers and
    what follows up to the next), which no merge can cross.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(self.MARK in p.lstrip(self.MARK) for p in names):
            raise ValueError("pieces of this model cross white-space markers; marked words can't be encoded apart")
        self.begin, self.end = array("I", [self.lib.bos_id()]).tobytes(), array("I", [self.lib.eos_id()]).tobytes()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.words = re.compile(f"{self.MARK}+[^{self.MARK}]*")

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if ("sp", path) not in _tables:
            _tables["sp", path] = cls(path)
        return _tables["sp", path]

    def marked(self, text: str) -> list[str]:
        """The marked words, each without its first marker."""
        if not text:
            return []
        text = text.replace(" ", self.MARK)
        if self.MARK * 2 not in text and text[0] != self.MARK:
            return text.split(self.MARK)
        return [w[1:] for w in self.words.findall(self.MARK + text)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids with begin and end as 32-bit bytes, decoded text) of each text."""
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        lists = [self.marked(t) for t in texts]
        new = list({w for x in lists for w in x if w not in known})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            # the library itself puts the first marker back; a word of no characters is a marker alone
            spaced = [w.replace(self.MARK, " ") for w in part]
            ids = self.lib.encode(spaced, num_threads=1)
            for k, w in enumerate(part):
                if not w:
                    ids[k] = [self.lib.piece_to_id(self.MARK)]
            for w, x, d in zip(part, ids, self.lib.decode(ids, num_threads=1)):
                known[w] = (array("I", x).tobytes(), d)
        out = []
        for x in lists:
            found = [known[w] for w in x]
            out.append((b"".join([self.begin, *[f[0] for f in found], self.end]), " ".join([f[1] for f in found])))
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out

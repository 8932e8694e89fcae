"""Token ids of whole texts, by the tokenizers library.

A text is cut where the tokenizer's own pre-tokenizer always cuts: before a space that precedes a word
("leading_space", byte-level BPE) or at white space that it drops ("words", BPE with word ends). Ids of such chunks
do not depend on their neighbours, so each worker encodes a chunk once and joins remembered ids; the result is that
of encoding the whole text, which the tests compare. `encode_all` takes many texts: their distinct chunks are looked up once,
and those of letters that are new go to the model in one call. Texts that hold an added token, such as an end-of-text
marker, are encoded whole. Tokenizers with another splitting rule take "whole".
"""

from __future__ import annotations

import re
from array import array

#: The characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and separators (Python splits at \x1c to \x1f, tokenizers do not) besides single spaces and line ends.
UNUSUAL = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that end a chunk and are a pre-token of their own after a letter: those of ASCII but the apostrophe.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

CHUNKS = {
    "leading_space": re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
    "words": re.compile(f"[^{WHITE}]+"),
}

#: Bytes, about, that a generation of a worker's memory of chunks takes at most, and that of those which are rare. Longer
#: chunks are encoded anew.
REMEMBERED, ASIDE, LONG_CHUNK = 72 << 20, 4 << 20, 64
#: Bytes of an entry beside its characters and ids: objects' heads and the dictionary's slot.
ENTRY = 160
#: Characters of a text beyond which it is encoded by itself.
LONG_TEXT = 16 << 20
#: Stands between words that are encoded in one call: a byte that letters don't have, and a pre-token of its own.
BETWEEN = "\x01"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a letter: itself if it is printable in Latin-1, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Chunk to ids; asks the tokenizer for what is missing, and forgets all when it is full.

    older: keeps what it held when it was full as an older generation, whose chunks need not be encoded anew.
    """

    def __init__(self, encode, marks, fold: bool = False, limit: int | None = None, older: bool = False):
        super().__init__()
        self.encode, self.marks, self.fold, self.held, self.old = encode, marks, fold, 0, {} if older else None
        self.limit = REMEMBERED if limit is None else limit

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if self.old and (before := self.old.get(chunk)) is not None:
            ids = before
        elif len(core) < len(chunk) and core[-1:].isalpha():
            ids = self[core] + self.marks(chunk[len(core) :])
        elif self.fold and chunk.isascii() and (low := chunk.lower()) != chunk:
            ids = self[low]
        else:
            ids = self.encode(chunk)
        if len(chunk) <= LONG_CHUNK:
            size = ENTRY + len(ids) + len(chunk) * (1 if chunk.isascii() else 4)
            if self.held + size > self.limit:
                if self.old is not None:
                    self.old = dict(self)
                self.clear()
                self.held = 0
            self[chunk] = ids
            self.held += size
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does by default.

    plain: added tokens are not recognised in texts, so that their ids can't occur.
    """

    def __init__(self, path: str, chunks: str = "whole", plain: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        added = {} if plain else self.tokenizer.get_added_tokens_decoder()
        #: Contents of added tokens: those that are looked for in the text, and those in the normalised text.
        self.added = [x.content for x in added.values() if not x.normalized]
        self.normalised = [self.normal(x.content) for x in added.values() if x.normalized]
        # only chunks of texts without added tokens go there
        self.tokenizer.encode_special_tokens = True
        self.chunks, self.fold = chunks, chunks == "words"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known = _Known(self.word, self.direct, self.fold, ASIDE if chunks == "leading_space" else None, older=self.fold)
        #: By word: the ids of the word after a space, or of the word at a line's start with its line end.
        self.spaced = _Known(lambda x: self.word(x, " "), self.known.__getitem__)
        #: The model by itself, for words that are pre-tokens.
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = Split(" ", "removed")
        #: By what stands before a word: ids of words of letters, those of an older generation, bytes of the younger.
        self.letter_words = {"": ({}, {}, 0), " ": ({}, {}, 0)}

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def marked(self, text: str) -> bool:
        """Whether an added token is in the text."""
        if any(x in text for x in self.added):
            return True
        if not self.normalised:
            return False
        text = self.normal(text)
        return any(x in text for x in self.normalised)

    def direct(self, text: str) -> bytes:
        (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", encoded.ids).tobytes()

    def word(self, text: str, space: str = "") -> bytes:
        """Ids of a chunk. Letters alone are one pre-token, which goes to the model at once; so is a line end before a word."""
        if space and text[:1] == "\n" and len(text) > 1:
            return self.known["\n"] + self.known[text[1:]]
        if self.fold:
            text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if not text.isalpha():
            return self.direct(space + text if text[:1] != "\n" else text)
        mapped = (space + text).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def regular(self, text: str) -> bool:
        """Whether all chunks of the text are parted by single spaces and line ends ("words": by any number of them)."""
        if any(x in text for x in UNUSUAL):
            return False
        return self.chunks == "words" or not (text[0] == " " or text[-1] == " " or any(x in text for x in ("  ", " \n", "\n ", "\n\n")))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marked(text):
            self.tokenizer.encode_special_tokens = False
            try:
                return self.direct(text)
            finally:
                self.tokenizer.encode_special_tokens = True
        if self.chunks == "whole":
            return self.direct(text)
        if not self.regular(text):
            return b"".join(map(self.known.__getitem__, CHUNKS[self.chunks].findall(text)))
        if self.chunks == "words":
            return b"".join(map(self.known.__getitem__, text.split()))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.known[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """What `encode` gives for each of the texts, which should be some MB together, or one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out, together, heads, rests, raw = [b""] * len(texts), [], [], [], False
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.chunks == "whole" or len(text) > LONG_TEXT or self.marked(text) or not self.regular(text):
                out[i] = self.encode(text)
                continue
            together.append(i)
            if not self.fold:
                head, _, rest = text.replace("\n", " \n").partition(" ")
                heads.append(head)
                rests.append(rest)
                continue
            text, simple = text.replace("\n", " "), latin(text)
            raw = raw or not simple
            rests.append(text.lower() if simple else text)
        if not together:
            return out
        parted = pc.split_pattern(pa.array(rests, pa.string()), " ")
        words = parted.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.fold:
            made = self.words(list(map(lower_latin, distinct)) if raw else distinct)
        else:
            made = self.words(distinct, " ")
            lines = [i for i, x in enumerate(distinct) if x[:1] == "\n" and len(x) > 1]
            for i, ids in zip(lines, self.words([distinct[i][1:] for i in lines]), strict=True):
                made[i] = self.known["\n"] + ids
        ids = pa.array(made, pa.binary()).take(words.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int32)[np.asarray(parted.offsets)].tolist()
        data = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        for k, i in enumerate(together):
            out[i] = data[starts[k] : starts[k + 1]]
        if not self.fold:
            for i, ids in zip(together, self.words(heads), strict=True):
                out[i] = ids + out[i]
        return out

    def words(self, chunks: list[str], space: str = "") -> list[bytes]:
        """Ids of chunks without white space, each after `space` if it isn't empty; a chunk that begins with a line end may have any.

        Words of letters, with marks after them or not, that aren't remembered go to the model in one call.
        """
        cores = [x.rstrip(MARKS) for x in chunks]
        young, old, held = self.letter_words[space]
        found = list(map(young.get, cores))
        made = {x: old.get(x) for x, ids in zip(cores, found, strict=True) if ids is None and x.isalpha() and len(x) <= LONG_CHUNK}
        if self.fold:
            made = {x: ids for x, ids in made.items() if latin(x)}
        made |= self.letters_only([x for x, ids in made.items() if ids is None], space)
        rest, out = self.spaced if space else self.known, []
        for chunk, core, ids in zip(chunks, cores, found, strict=True):
            if ids is None and (ids := made.get(core)) is None:
                ids = (b"" if chunk[:1] == "\n" and len(chunk) > 1 else rest[chunk]) if chunk else b""
            elif len(core) < len(chunk):
                ids += self.known[chunk[len(core) :]]
            out.append(ids)
        held += ENTRY * len(made) + sum(map(len, made.values())) + sum(len(x) if x.isascii() else 4 * len(x) for x in made)
        if held > REMEMBERED // (1 if self.fold else 2):
            self.letter_words[space] = ({}, young | made, 0)
        else:
            young.update(made)
            self.letter_words[space] = (young, old, held)
        return out

    def letters_only(self, words: list[str], space: str) -> dict[str, bytes]:
        """Ids of distinct words of letters, each a pre-token with the space."""
        import numpy as np

        if not words:
            return {}
        text = f"\n{space}".join(["", *words]).encode().decode("latin-1").translate(self.letters)
        between = self.letters[ord(BETWEEN)]
        (encoded,) = self.bare.encode_batch_fast([text.replace(self.letters[ord("\n")], f" {between} ")], add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4")
        begins, data = (4 * np.flatnonzero(ids == ids[0]) + 4).tolist(), ids.tobytes()
        return {x: data[a:b] for x, a, b in zip(words, begins, [*(a - 4 for a in begins[1:]), len(data)], strict=True)}


def latin(text: str) -> bool:
    """Whether a text is in Latin-1, where small letters are one for one and all is composed."""
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def lower_latin(word: str) -> str:
    return word.lower() if latin(word) else word


_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, chunks: str, plain: bool = False) -> Encoder:
    """The worker's own encoder for this file."""
    if (path, chunks, plain) not in _encoders:
        _encoders[path, chunks, plain] = Encoder(path, chunks, plain)
    return _encoders[path, chunks, plain]

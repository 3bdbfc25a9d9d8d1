"""Token ids of texts, looked up a word at a time.

Neither tokenizer family here lets a token reach over the spaces that the callers cut at, so
the ids of a text are those of its words in a row, and a word met before isn't encoded again.
"""

import gc
import os
import re
from itertools import chain

import numpy as np

# A task's table of words starts anew beyond so many words or bytes.
MOST_WORDS, MOST_BYTES = 1 << 19, 1 << 25
# So many words are encoded as one text.
_JOINED = 256

_IDS = np.dtype("<u4")


def byte_alphabet() -> dict:
    """Character of a byte-level vocabulary to its byte: printable Latin-1 stands for itself, the
    other bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def tokenizer(path: str, special_as_text: bool):
    """The tokenizer of a file, on one thread; special tokens' strings in a text are text, or the tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    return made


def token_bytes(made) -> list:
    """The bytes of each id of a byte-level vocabulary."""
    alphabet = byte_alphabet()
    table = [b""] * made.get_vocab_size()
    for token, k in made.get_vocab().items():
        table[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return table


def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(model) -> list:
    """The bytes of each id of a piece vocabulary; U+2581 is a space."""
    return [
        bytes([int(model.id_to_piece(k)[3:-1], 16)]) if model.is_byte(k)
        else model.id_to_piece(k).replace("▁", " ").encode()
        for k in range(model.vocab_size())
    ]


class _Table:
    """Words to their ids, as little-endian unsigned 32-bit numbers in bytes.

    encode maps a list of words to a list of such bytes.
    """

    def __init__(self, encode, most: int = MOST_WORDS):
        self.encode, self.most, self.known, self.size = encode, most, {}, 0

    def learn(self, words) -> None:
        """Enters the words; earlier ones may go to make room."""
        if len(self.known) > self.most or self.size > MOST_BYTES:
            self.known, self.size = {}, 0
        new = list(set(words).difference(self.known))
        # The tables are many objects without cycles, which the collector would visit again and again.
        gc.disable()
        try:
            values = self.encode(new)
        finally:
            gc.enable()
        self.known.update(zip(new, values, strict=True))
        self.size += sum(map(len, new)) + sum(map(len, values))

    def of(self, words: list) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def packed(ids) -> bytes:
    return np.array(ids, _IDS).tobytes()


class WordIds(_Table):
    """The table for texts, each a list of words."""

    def learn(self, texts: list) -> None:
        super().learn(chain.from_iterable(texts))


class JoinedEncoder:
    """Ids of words of a tokenizer that splits a text into parts before it merges.

    A word that `plain` matches is a row of parts, by `part`, which are encoded apart: words differ in
    fewer parts. Many parts, or words that `whole` matches, are encoded as one text. Those that `free`
    matches stand with `between` behind each, and ends(lot, ids) tells the places behind their last
    ids; the others have `mark` between them, which becomes one id of its own. No such word may hold what
    stands between, or depend on what stands beyond it. All other words are encoded one by one.
    """

    def __init__(self, made, plain: str, part: str, whole: str, mark: str, free: str, between: str, ends):
        self.made, self.split, self.mark, self.between, self.ends = made, re.compile(part).findall, mark, between, ends
        self.plain, self.whole, self.free = (re.compile(x).fullmatch for x in (plain, whole, free))
        self.mark_id = made.encode(mark, add_special_tokens=False).ids
        if len(self.mark_id) != 1:
            raise ValueError("the mark must be one token")
        self.parts = _Table(self._joined, MOST_WORDS // 2)

    def _row(self, word):
        """The word's only part, or a list of its parts; None for a word to encode by itself."""
        if self.plain(word):
            parts = self.split(word)
            return parts[0] if len(parts) == 1 else parts
        return word if self.whole(word) else None

    def __call__(self, words: list) -> list:
        rows = list(map(self._row, words))
        several = chain.from_iterable(row for row in rows if type(row) is list)
        self.parts.learn(chain((row for row in rows if type(row) is str), several))
        others = iter(self._alone([word for word, row in zip(words, rows, strict=True) if row is None]))
        known, of = self.parts.known, self.parts.of
        return [known[row] if type(row) is str else of(row) if row else next(others) for row in rows]

    def _alone(self, words):
        return [packed(e.ids) for e in self.made.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words):
        free = [self.free(word) is not None for word in words]
        own = iter(self._cut([w for w, f in zip(words, free, strict=True) if f], self.between, self.ends, 0))
        others = iter(self._cut([w for w, f in zip(words, free, strict=True) if not f], self.mark, self._marked, 1))
        return [next(own if f else others) for f in free]

    def _marked(self, lot, ids):
        return np.flatnonzero(ids == self.mark_id[0])

    def _cut(self, words, between, ends, skip):
        """The words' ids; ends tells of each word the place behind its last id, skip ids are behind that."""
        lots = [words[at:at + _JOINED] for at in range(0, len(words), _JOINED)]
        texts = ["".join(word + between for word in lot) for lot in lots]
        out = []
        for lot, found in zip(lots, self.made.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, _IDS)
            places = ends(lot, ids)
            if len(places) != len(lot) or places[-1] + skip != len(ids):
                out += self._alone(lot)
                continue
            data, at = ids.tobytes(), 0
            for end in (4 * places).tolist():
                out.append(data[at:end])
                at = end + 4 * skip
        return out


# Latin letters beyond ASCII, without the one that lower case makes two signs of. None is changed by
# composition, or by what isn't a combining sign behind it.
_LATIN = "À-ÖØ-öø-įı-ɏ"
_SIGNS = r"[!-/:-@\[-`{-~]+"
_SHORTENED = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_level_encoder(made) -> JoinedEncoder:
    """For byte-level BPE whose parts are contractions and runs of letters, digits or other signs, each of
    the runs with a space before it. Words may start with that space; those of ASCII signs and Latin letters
    are plain, and such parts with a space before them need nothing between them."""
    sizes = np.array([len(token) for token in token_bytes(made)])
    runs = [f"[A-Za-z{_LATIN}]+", "[0-9]+", _SIGNS]

    def ends(lot, ids):
        reached, wanted = np.cumsum(sizes[ids]), np.cumsum([len(word.encode()) for word in lot])
        places = np.searchsorted(reached, wanted)
        return places + 1 if places[-1] < len(ids) and (reached[places] == wanted).all() else places[:0]

    return JoinedEncoder(made, plain=f" ?[!-~{_LATIN}]+", part="|".join([_SHORTENED, *(f" ?{run}" for run in runs)]),
                         whole=r" ?\S+", mark="\n", free=f" (?:{'|'.join(runs)})", between="", ends=ends)


def word_end_encoder(made) -> JoinedEncoder:
    """For BPE with word ends, in lower case, whose parts are contractions, runs of letters, digits one by
    one and runs of other signs. Words of ASCII signs but capitals, and Latin letters, are plain, if no
    special token is in them, and each of their parts has one id that ends a word."""
    vocabulary = made.get_vocab()
    last = np.zeros(len(vocabulary), bool)
    last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
    parts = f"{_SHORTENED}|[a-z{_LATIN}]+|[0-9]|{_SIGNS}"
    return JoinedEncoder(made, plain=rf"(?:(?!<\|)[!-@\[-~{_LATIN}])+", part=parts, whole=r"(?:(?!<\||\x01)\S)+", mark=" \x01 ",
                         free=parts, between=" ", ends=lambda lot, ids: np.flatnonzero(last[ids]) + 1)

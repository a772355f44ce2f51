"""Line-first quality rules (operator 8): bad lines go, then documents that lose too much text go.

A line fails on punctuation, navigation or boilerplate; a document is rejected by the base rule or when
the lines that it loses hold more than a fixed share of its word characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkforge.llm import words
from linkforge.runtime import ship

#: Base rule: fewer words than this, or more than this percentage of words in repeated five-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Share of word characters (percent) that failing lines may hold before the document goes.
MOST_LOST = 40
#: Line rules need this many words to judge shares by.
JUDGED_WORDS = 4

_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_DOUBLED = re.compile(rb"([!?#*$%&=~_])\1")

# Phrases that mark boilerplate lines, in English, German, French and Spanish.
BOILERPLATE = re.compile(
    "cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|javascript (?:is )?(?:disabled|required)|enable javascript|"
    "subscribe to our|sign up for|click here|read more|log in|skip to (?:main )?content|share on (?:facebook|twitter)|lorem ipsum|powered by|"
    "alle rechte vorbehalten|datenschutzerklärung|allgemeine geschäftsbedingungen|cookie-richtlinie|hier klicken|mehr lesen|weiterlesen|newsletter abonnieren|"
    "jetzt anmelden|zum inhalt springen|nutzungsbedingungen|tous droits réservés|politique de confidentialité|mentions légales|cliquez ici|lire la suite|"
    "conditions (?:générales )?d.utilisation|abonnez-vous|se connecter|aller au contenu|todos los derechos reservados|política de (?:privacidad|cookies)|aviso legal|"
    "términos (?:y condiciones|de uso)|haga clic aquí|leer más|suscríbe(?:te|ase)|iniciar sesión|saltar al contenido".encode(),
    re.IGNORECASE,
)
# Marks that stand between menu entries. Guillemets count where no opening one makes them quotation marks.
SEPARATORS = ("|", ">", "»", "›", "·", "•", "/", "::", "→")
_BETWEEN = frozenset(x.encode() for x in SEPARATORS)
_COMMON = frozenset(x.encode() for x in SEPARATORS[:3])
_OPEN, _CLOSE = ("«".encode(), "‹".encode()), ("»".encode(), "›".encode())


def line_fails(line: bytes, n_words: int, row: list[bytes] | None = None) -> bool:
    """Whether a line with words (``row``, or split here) fails. Navigation: marks of one kind stand alone between
    entries of four words or fewer on average (seven for the commonest marks), twice at least. Punctuation: doubled marks on a fifth of the
    words or more. Shouting: nine in ten ASCII letters are capitals. Stutter: half of the words repeat the word
    before them. Boilerplate: one of the phrases in a line of up to 20 words."""
    row = line.split() if row is None else row
    for mark in _BETWEEN.intersection(row):
        n = row.count(mark)
        if mark in _CLOSE:
            n -= max(0, sum(line.count(x) for x in _OPEN))
        if n >= 2 and n_words - n <= (7 if mark in _COMMON else 4) * (n + 1):
            return True
    if n_words >= JUDGED_WORDS:
        if 5 * len(_DOUBLED.findall(line)) >= n_words or 2 * sum(map(bytes.__eq__, row, row[1:])) >= n_words:
            return True
        letters = line.translate(None, _NOT_LETTERS)
        if len(letters) >= 20:
            plain = letters.translate(None, bytes(range(128, 256)))
            if plain and 10 * sum(map(str.isupper, plain.decode())) >= 9 * len(plain):
                return True
    return n_words <= 20 and BOILERPLATE.search(line) is not None


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def repeated_words(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row: words in five-word windows that the row holds twice or more."""
    out = np.zeros(len(counts), np.int64)
    grams = words.rolling(flat, WINDOW)
    at = np.flatnonzero(words.inside(counts, WINDOW, len(grams)))
    if not len(at):
        return out
    row = np.searchsorted(np.cumsum(counts), at, side="right")
    order = np.lexsort((grams[at], row))
    g, r = grams[at][order], row[order]
    same = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order][twice]
    edge = np.zeros(len(flat) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    starts, ends = words.spans(counts)
    return covered[ends] - covered[starts]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            texts = words.raw_texts(part)
            rows = [t.split() for t in texts]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            repeats = repeated_words(words.hashed([w for row in rows for w in row]), counts)
            chars, symbols, copies, lost, cleaned, was_cut = [], [], [], [], [], []
            for text, row in zip(texts, rows):
                chars.append(_points(b"".join(row)))
                symbols.append(len(text.translate(None, _SYMBOLS)))
                seen, dup, gone, kept = set(), 0, 0, []
                for line in text.split(b"\n"):
                    parts = line.split()
                    if parts:
                        dup += line in seen
                        seen.add(line)
                        if line_fails(line, len(parts), parts):
                            gone += _points(b"".join(parts))
                            continue
                    kept.append(line)
                copies.append(dup)
                lost.append(gone)
                was_cut.append(gone > 0)
                cleaned.append(b"\n".join(kept) if gone else text)
            n, total = counts, np.asarray(chars, np.int64)
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
            kept_rows = ~failed & (100 * np.asarray(lost, np.int64) <= MOST_LOST * total)
            null = np.asarray(part.column("text").is_null())
            clean = pa.array(cleaned, pa.binary(), mask=null).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in (n, total, symbols, copies, repeats, lost)), pa.array(failed), pa.array(kept_rows), clean, *part.columns[2:]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text", *part.schema.names[2:]],
            )


def quality_rules(docs: DataFrame, rest: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text.

    Words are runs of characters other than ASCII white space. word_chars counts code points in words,
    n_symbols the characters #*$%&|<>, n_dup_lines the lines with a word that equal an earlier line of the
    text, n_repeat_words the words in five-word windows that occur twice or more in the text. base_failed:
    fewer than 10 words, or over 20 % repeated words. kept: not base_failed, and failing lines hold at most
    40 % of the word characters. clean_text is the text without its failing lines. Null and empty texts
    have zero counts, fail the base rule, and stay as they are. Every row is judged by itself, so repeated
    rows and null ids change nothing. Other columns are ignored, but for ``rest``: it comes along as a column
    of that name. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    more = [] if rest is None else [rest.alias("rest")]
    docs = words.id_and_text(docs, *more)
    schema = T._parse_datatype_string(
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_chars long, base_failed boolean, kept boolean, clean_text string"
    )
    for field in docs.schema.fields[2:]:
        schema = schema.add(field)
    return docs.mapInArrow(_judge, schema)

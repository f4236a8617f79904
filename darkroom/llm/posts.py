"""A post's own sentences: without quoted parts and signature."""

from __future__ import annotations

import html
import re

_QUOTE = re.compile(r"\[quote(?:=[^\]]*)?\](?:(?!\[quote(?:=[^\]]*)?\]|\[/quote\]).)*\[/quote\]", re.S | re.I)
_BLOCK = re.compile(r"<blockquote[^>]*>(?:(?!<blockquote).)*?</blockquote>", re.S | re.I)
_MARKED_LINE = re.compile(r"^[ \t]*(?:>|&gt;|»).*$", re.M)
_ATTRIBUTION = re.compile(r"^[^\n]{0,80}\b(?:wrote|writes|said|schrieb|escribió|dijo):[ \t]*$", re.M | re.I)
_SIGNATURE = re.compile(r"(?:^|\n)(?:-- ?|_{3,}|={3,}|\*{3,})[ \t]*\n|<hr ?/?>|(?:^|\n)(?=~{2,}[^\n]*~{2,}\s*$)", re.I)
_BREAK_TAG = re.compile(r"<(?:br|p|/p|div|/div|li|/li|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[img\][^\[]*\[/img\]|\[/?[A-Za-z]+(?:=[^\[\]]*)?\]", re.I)
#: A closing line without full stop and of more words is a sentence that was left unfinished, not a signature.
SIGNATURE_WORDS = 10
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n\s*\n")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_ENDED = re.compile(r"[.!?…:)\"'>]$")
#: A short answer to the question before it, which it belongs to: it begins with a pronoun.
_ANSWER = re.compile(r"^(?:It|Its|Mine|Yours|Ours|Theirs|They|He|She) [a-z]")
_HAS_WORD = re.compile(r"[^\W\d_]")
#: What stands for a sentence in chat without a full stop.
_INTERJECTION = re.compile(r"(?:lol|rofl|thx|\+1|[:;]-?[()DP])(?=\s|$)", re.I)
_NOTE = re.compile(r"^(?:edit|re|p\.?s\.?):\s*", re.I)


def own_text(text: str) -> str:
    """The post without quotes (marked lines, quote tags, block quotes, however nested), attribution lines and signature."""
    before = None
    while before != text and ("[/" in text or "</" in text):
        before = text
        text = _BLOCK.sub("\n\n", _QUOTE.sub("\n\n", text))
    if ">" in text or "&gt;" in text or "»" in text:
        text = _MARKED_LINE.sub("\n", text)
    if ":" in text:
        text = _ATTRIBUTION.sub("\n", text)
    for m in _SIGNATURE.finditer(text):
        if not _PARAGRAPH.search(text[m.end() :].strip()):  # what a mark opens is the signature if it is the post's last paragraph
            text = text[: m.start()]
            break
    *body, last = _PARAGRAPH.split(text.rstrip())
    bare = _TAG.sub(" ", last).strip()
    if body and "\n" not in bare and " " in bare and not _ENDED.search(bare) and not _INTERJECTION.match(_NOTE.sub("", bare)):
        plain = _TAG.sub(" ", _BREAK_TAG.sub("\n\n", last))
        begin = max((m.end() for m in _SENTENCE_END.finditer(plain) if plain[m.end() :].strip()), default=0)
        if len(plain[begin:].split()) <= SIGNATURE_WORDS:
            text = "\n\n".join([*body, plain[:begin]])  # a closing line that is no sentence; the sentences before it stay
    return text


def sentences(text: str) -> list[str]:
    """Sentences of a post's own text. A line break alone ends none; a short answer belongs to the question before it; an interjection at the begin of a piece is a
    sentence of its own."""
    plain = own_text(text)
    if "<" in plain or "[" in plain:
        plain = _TAG.sub(" ", _BREAK_TAG.sub("\n\n", plain))
    if "&" in plain:
        plain = html.unescape(plain)
    out: list[str] = []
    for piece in _SENTENCE_END.split(plain):
        piece = " ".join(piece.split())
        while m := _INTERJECTION.match(piece):
            out.append(m.group())
            piece = piece[m.end() :].lstrip()
        if not _HAS_WORD.search(piece):
            continue
        if _INTERJECTION.match(_NOTE.sub("", piece)) is None and out and out[-1].endswith("?") and _ANSWER.match(piece):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out

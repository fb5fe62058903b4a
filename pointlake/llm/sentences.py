"""Sentences of texts in any language and script.

Every place where a sentence may end - a mark, a line break, a gap in a script without sentence marks - is a node of a
lattice over the whole text. What stands before and after it is evidence for or against an end there, and as the start of the
sentence matters, the evidence depends on the path; of all divisions the one of most evidence is taken. In spaced scripts the
evidence is that of the terminator: abbreviations, ordinals, initials, speech, letter case, line layout. In spaceless scripts
the runs beside a gap are segmented by a dictionary word lattice, and final particles and opening words decide.

Words that open sentences are counted in the corpus itself; the fixed lists hold function words and abbreviations.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm import sentence_words as W
from pointlake.plans import scratch

NEVER = W.words(W.NEVER_LAST)
NUMBER = W.words(W.BEFORE_NUMBER)
MAYBE = W.words(W.MAYBE_LAST)
LISTS = W.words(W.CLOSES_LIST)
INNER = NEVER | MAYBE | LISTS
ROLES = INNER | NUMBER
ORDINAL = W.words(W.BEFORE_ORDINAL)
TIED = W.words(W.TIED)
OPENS = W.words(W.OPENS)
ON = W.words(W.CARRIES_ON)
SAYS = W.words(W.SAYS)
THAI_FINAL = W.words(W.THAI_FINAL)
THAI = {**dict.fromkeys(W.words(W.THAI_WORDS), 1.0), **dict.fromkeys(THAI_FINAL, 0.8)}
CJK_BEFORE, CJK_FINAL, AFTER_SPEECH = W.words(W.CJK_BEFORE), W.words(W.CJK_FINAL), W.words(W.CJK_AFTER_SPEECH)
THAI_OPENS, THAI_CLOSES, CJK_OPENS = W.words(W.THAI_OPENS), W.words(W.THAI_CLOSES), W.words(W.CJK_OPENS)
THAI |= {w: 1.0 for w in THAI_OPENS | THAI_CLOSES if w not in THAI}
CJK = {**dict.fromkeys(CJK_OPENS, 1.0), **dict.fromkeys(CJK_BEFORE, 1.0), **dict.fromkeys(CJK_FINAL, 1.0)}

#: Marks that end sentences: those that Unicode calls terminals of sentences in any script, but the point and the marks of
#: phrases of Burmese and Tibetan-like scripts; the Arabic semicolon is none. Pairs of quotes and brackets.
WIDE = "。！？｡"
STRONG = "".join(c for c in map(chr, range(0x21, 0x20000)) if regex.match(r"\p{Sentence_Terminal}", c) and c not in ".\u104a\u2024\ufe52\uff0e")
ENDS = ".…" + STRONG
PAIRS = {"«": "»", "“": "”", "„": "“”", "‚": "‘’", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "〈": "〉", "【": "】"}
CLOSERS = "»”“’‘」』)）]》〉】\"'"
BRACKETS = "(（[【"
#: How far behind the best division another one may lie and still be followed. Evidence lies between -3 and 3, and a place
#: that is decided by half of that or more leaves no second path.
MARGIN = 3.0
#: Share of all openings from which on a word counts as one that opens sentences; so there are at most 1 / OPENING of them.
OPENING = 2e-4

_IGNORED = regex.compile(r"[­​‌‎‏⁠﻿]")
_EMOJI = r"(?:[\p{So}\p{Emoji_Presentation}\p{RI}][‍️︎\p{EMod}\p{So}\p{Emoji_Presentation}\p{RI}]*)"
_EMOJI_RUN = regex.compile(rf"[ \t 　]*{_EMOJI}(?:[ \t ]*{_EMOJI})*")
_MARKS = re.compile(rf"[.…;\u037e{re.escape(STRONG)}]+(?:[\u00a0\u202f][!?]+)*")
_BREAK = re.compile(r"[^\S\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*")
_LIST = regex.compile(r"(?:[-*•‣◦▪–—]|\(?\d{1,3}[.)])[ \t ]+(?=\S)")
_NUMBERED = re.compile(r"\(?\d{1,3}[.)]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’.\-‑]*[\p{L}\p{M}\p{N}])?")
_TOKEN = regex.compile(r"(?r)\S{1,60}")  # matched backwards from a place
_WORDS_BEFORE = regex.compile(r"(?r)[^\s。！？，、]+")
_AHEAD = re.compile(r"[^\s。！？，、]*")
_NEWLINE = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]")
_ADDRESS = regex.compile(r"www\.|://|@|[=_\\]")
_THAI_GAP = regex.compile(rf"(?<=[฀-๿])(?:{_EMOJI_RUN.pattern}[ \t\xa0　]*|[ \t\xa0　]+)(?=\S)")
_CJK_GAP = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])[ \u00a0\u3000]+(?=[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")
_LINE = re.compile(r"[^\r\n\x85  ]*")
_PARAGRAPH = re.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:\r?\n|\r)")
_INNER_END = regex.compile(r"(?:[!?।॥؟]|[\p{L}\p{M}]{4}\.)[^\S\r\n]+[^\s]")
_PIECES = regex.compile(r"(?:\p{L}{1,2}\.){1,3}(?=\s)")
_PIECE = regex.compile(r"(\p{L}{1,4})\.")
_CASED = regex.compile(r"[\p{Lu}\p{Ll}\p{Lt}]")
_SPACELESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_OUTER = " \t\n\r\x0b\x0c"
_BLANK_LINE = re.compile(r"\n\s*\n")
_AFTER_END = regex.compile(r"(?:[!?]|\p{Ll}{3}\.)\s+(?=(\p{L}))")
_QUOTES = re.compile(r"[«»“”„‚‘’「」『』()（）\[\]《》〈〉【】\"']")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_JOINTS = regex.compile(r"[.\-]")
_INITIALS = regex.compile(r"(?:\p{L}\p{M}*\.)+\p{L}\p{M}*")
_FIGURES = regex.compile(r"\d+(?:\.\d+)*")
_CLAUSE = re.compile(r"[\s。！？，、]")
_SHOWN = regex.compile(r"[\p{L}\p{N}\p{So}]")
_RUN = regex.compile(r"(?r)[\p{L}\p{M}\p{N}%°'’]+")


@lru_cache(maxsize=50_000)
def _lattice(text: str, thai: bool) -> tuple[str, ...]:
    """The cheapest division of a short text into dictionary words and unknown characters."""
    words = THAI if thai else CJK
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(end, 8) + 1):
            word = text[end - size : end]
            cost = words.get(word, 2.0 if size == 1 else None)
            if cost is not None and best[end - size][0] + cost < best[end][0]:
                best[end] = (best[end - size][0] + cost, end - size)
    out, at = [], len(text)
    while at:
        out.append(text[best[at][1] : at])
        at = best[at][1]
    return tuple(reversed(out))


class _Text:
    """One text without its invisible characters, and what is known of it."""

    def __init__(self, text: str, opens: frozenset[str]) -> None:
        self.text, self.opens = text, opens
        self.quote: dict[int, int] = {}  # closer -> opener
        self.inside: list[tuple[int, int]] = []  # speech and remarks that keep a sentence together
        self.flow: dict[int, bool] = {}
        self._pair()

    @cached_property
    def lower(self) -> bool:
        """Whether sentences open with small letters too."""
        letters = [m.group(1) for m in _AFTER_END.finditer(self.text)]
        return bool(letters) and sum(c.islower() for c in letters) * 3 >= len(letters)

    @cached_property
    def cuts(self) -> list[int]:
        return [0, *(m.end() for m in _PARAGRAPH.finditer(self.text))]

    def flows(self, at: int) -> bool:
        """Whether some line of the paragraph holds the end of a sentence and more."""
        n = bisect_right(self.cuts, at) - 1
        if n not in self.flow:
            self.flow[n] = bool(_INNER_END.search(self.text[self.cuts[n] : self.cuts[n + 1] if n + 1 < len(self.cuts) else len(self.text)]))
        return self.flow[n]

    def _pair(self) -> None:
        text, open_ = self.text, []
        for m in _QUOTES.finditer(text):
            i, c = m.start(), m.group()
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < len(text) else " "
            if c in "\"'":
                held = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == c), None)
                if c == "'" and before.isalnum() and after.isalnum():
                    continue
                if held is not None and (not before.isspace() or after.isspace()):
                    self._close(open_, held, i)
                elif not after.isspace() and (before.isspace() or (held is None and before in ENDS and after.isupper()) or (c == '"' and not before.isalnum()) or before in PAIRS or (c == '"' and held is None)):
                    open_.append((c, i))
                continue
            held = next((k for k in range(len(open_) - 1, -1, -1) if c in PAIRS.get(open_[k][0], "")), None)
            if held is not None and not (c in "’‘" and before.isalnum() and after.isalnum()):
                self._close(open_, held, i)
            elif c in PAIRS:
                open_.append((c, i))

    def _close(self, open_: list[tuple[str, int]], held: int, at: int) -> None:
        start = open_[held][1]
        del open_[held:]
        if not _BLANK_LINE.search(self.text, start, at):
            self.quote[at] = start
            self.inside.append((start, at))


def _emoji(text: str, at: int) -> regex.Match | None:
    """Emoji from a place on, blanks before and between them included."""
    j = at
    while j < len(text) and text[j] in " \t\u00a0\u3000":
        j += 1
    return _EMOJI_RUN.match(text, at) if j < len(text) and text[j] >= "\u00a9" else None


def _next_word(text: str, at: int) -> str:
    m = _WORD.search(text, at, at + 80)
    return m.group().split(".")[0].casefold() if m else ""


def _first_letter(text: str, at: int) -> str:
    if at < len(text) and text[at].isalnum() and text[at] < "\u0250":
        return text[at]
    m = _LETTER.search(text, at, at + 12)
    return m.group() if m else ""


def _case(text: str, at: int, token: str) -> str:
    """What the letter case at a place tells: upper, lower, or nothing (``none`` without case, ``shout`` in capitals)."""
    if text[at : at + 1].isupper() and text[at + 1 : at + 2].islower():
        return "upper"
    c = _first_letter(text, at)
    if not c or c.isdigit() or not _CASED.match(c):
        return "digit" if c and c.isdigit() else "none"
    word = _WORD.search(text, at, at + 80)
    if c.islower():
        return "upper" if word and word.start() <= text.find(c, at) and any(x.isupper() for x in _JOINTS.split(word.group())[0]) else "lower"
    second = _WORD.search(text, word.end(), word.end() + 40) if word else None
    loud = word and word.group().isupper() and (len(word.group()) > 1 or second is not None and second.group().isupper())
    letters = [x for x in token if x.isalpha()]
    if loud and letters and all(x.isupper() for x in letters):
        return "shout"
    return "upper"


@lru_cache(maxsize=100_000)
def _abbreviation(token: str, before: str) -> frozenset[str]:
    """Roles that a token before a point can have, alone or with the piece before it (as in two-part abbreviations)."""
    bare = token.casefold().strip("«»“”„‚‘’「」()（）[]\"'¿¡,;:—–").rstrip(".")
    roles = set()
    for form in (bare, f"{before}.{bare}" if before else bare):
        roles |= {n for n, s in (("never", NEVER), ("number", NUMBER), ("maybe", MAYBE), ("list", LISTS)) if form in s}
    if before and not roles & {"list"} and f"{before}.{bare}" in NEVER:
        roles -= {"maybe"}
    if len(bare) == 1 and bare.isalpha():
        roles.add("letter")
    elif _INITIALS.fullmatch(bare):
        roles.add("letters")
    elif _FIGURES.fullmatch(bare):
        roles.add("digits")
    return frozenset(roles)


def _full_stop(t: _Text, start: int, end: int, after: int, sentence: int) -> float:
    """Evidence that a single point at ``start`` ends a sentence; text goes on at ``after``, after a space or line break."""
    text = t.text
    m = _TOKEN.match(text, max(sentence, start - 60), start)
    token = m.group() if m else ""
    if len(token) > 5 and token.isalpha() and text[after].isupper() and text[after + 1 : after + 2].islower() and token.casefold() not in ROLES and text[start - len(token) - 2 : start - len(token) - 1] != ".":
        return 2.0  # a whole word before the point, a capital after it
    earlier = text[max(sentence, start - len(token) - 24) : max(sentence, start - len(token))].rstrip()
    lead = _TOKEN.match(earlier)
    before = lead.group().casefold() if lead else ""
    piece = before.strip("(«„\"'").rstrip(".") if before.endswith(".") and len(before) <= 6 else ""
    roles = _abbreviation(token, piece)
    case = _case(text, after, token)
    opener = text[after] in "¿¡«„“‚‘「『\"'"
    bare = token.casefold().strip("«»“”„‚‘’()[]\"'¿¡,;:").rstrip(".")
    joined = _PIECE.match(text, after)
    if joined and f"{bare}.{joined.group(1).casefold()}" in INNER:
        return -3.0  # the first part of an abbreviation in two parts
    word = _next_word(text, after)
    style_free = case in ("upper",)  # letter case of the next word is evidence
    if "digits" in roles:
        role = before.rstrip(".")
        if case == "digit" and not opener:
            return -1.0 if role in ORDINAL else 1.0
        if role in ORDINAL and "list" not in roles:
            return -2.0
        if role in NUMBER or role in NEVER:
            return 2.0
        return 1.0 if case in ("upper", "none", "shout") or opener else (1.0 if t.lower and word in t.opens else -1.0)
    if "list" in roles:
        if case in ("upper", "none") or opener:
            return 2.0
        return 1.0 if t.lower or case == "shout" and word not in ON else -1.0
    if "number" in roles and case == "digit":
        return -3.0
    if "never" in roles:
        if "maybe" not in roles:
            return -3.0
        # a word of both kinds, as a year's or a town's: the number before it tells
        counted = bool(lead) and before[-1:].isdigit()
        if not counted:
            return -3.0
    if roles & {"maybe"}:
        if token.casefold().rstrip(".") in ("г",) and not before[-1:].isdigit():
            return -3.0
        if style_free or opener:
            return 1.5
        if case in ("lower", "shout"):
            return 0.5 if word in t.opens and word not in ON and (t.lower or case == "shout") and word not in ("on", "in", "for", "at", "as", "with", "mit", "con", "a", "на", "в", "с") else -1.5
        return -0.5 if case == "digit" else 1.0
    if "letter" in roles:
        return -2.0
    if "letters" in roles:
        return 1.0 if style_free or opener else -1.5
    if "number" in roles and case == "lower":
        return -1.0
    if case == "digit" and "number" not in roles:
        return 1.5
    return 2.0


def _pause(t: _Text, start: int, after: int, sentence: int, marks: str) -> float:
    """Evidence that dots of omission end a sentence."""
    text = t.text
    spaced = start > 0 and text[start - 1].isspace()
    left = text[max(sentence, start - 12) : start].rstrip()
    right = text[after : after + 12]
    if left and _SPACELESS.match(left[-1]) and not "฀" <= left[-1] <= "໿":
        tail, head = _lattice(_run(text, sentence, start), False), _lattice(_AHEAD.match(text, after).group(), False)
        if tail and tail[-1] in CJK_BEFORE and not (len(tail) > 1 and "".join(tail[-2:]) in CJK_FINAL):
            return -2.0
        if tail and tail[-1] in CJK_FINAL:
            return 2.0
        if head and head[0] in AFTER_SPEECH:
            return -1.0
        return -0.5 if marks.startswith("……") else 1.0
    if spaced:
        return -1.5 if _case(text, after, text[max(0, start - 12) : start]) != "upper" or len(text[sentence:start].split()) <= 2 else 0.5
    case, word = _case(text, after, text[max(0, start - 12) : start].split()[-1] if text[max(0, start - 12) : start].split() else ""), _next_word(text, after)
    held = len(text[sentence:start].split())
    if case == "upper":
        return 2.0 if held > 1 else 0.5
    if word in ON and case != "upper" or held <= 1:
        return -1.5
    if case in ("lower", "shout"):
        return (0.5 if held >= 3 else -0.5) if t.lower or case == "shout" else -1.5
    return 1.0


def _after_speech(t: _Text, close: int, after: int, sentence: int, gap: bool) -> float:
    """Evidence that a sentence ends with speech or a remark that itself ends with a mark."""
    text = t.text
    start = t.quote.get(close)
    if start is None:
        return 1.0
    lead = text[sentence:start].strip(_OUTER + " 　")
    lead = _LIST.sub("", lead + " ", count=1).strip() if lead else lead
    if text[start] in BRACKETS:
        return 2.0 if not lead else -2.0
    nxt = text[after] if after < len(text) else ""
    if nxt in ",，、;:—–-…":
        return -3.0
    word = _next_word(text, after)
    told = lead.endswith((":", "："))
    if nxt and _SPACELESS.match(nxt):
        head = _lattice(_AHEAD.match(text, after).group(), False)
        if head and head[0] in AFTER_SPEECH and not gap:
            return -2.0
        return 1.5 if told or gap and not lead else (0.5 if gap else -1.5)
    case = _case(text, after, text[start:close])
    if word in ON and case != "upper":
        return -1.5
    if told:
        return 2.0 if case != "lower" or t.lower else 1.0
    if word in SAYS or word in ("a", "s'est") and _next_word(text, after + 2) in SAYS:
        return -2.0
    if case == "upper":
        return 1.5
    if case == "none":
        return -0.5 if lead else 1.0
    if case == "digit":
        return 0.5 if not lead else -0.5
    if not lead:
        return 0.5 if t.lower or case == "shout" else -1.5
    return 0.5 if word in t.opens and word not in ON and (t.lower or case == "shout") and word not in ("on", "in", "for", "at") else -1.5


def _line_break(t: _Text, start: int, end: int, sentence: int, midline: bool) -> float:
    """Evidence that a line break after no mark ends a sentence."""
    text = t.text
    gap = text[start:end]
    if text[start - 1] in "-‐­" and start > 1 and not text[start - 2].isspace() and text[start - 2] not in "-‐":
        return -3.0
    if text[start - 1] in ",，、;:：؛،(（«„“「/&+=":
        return -2.0 if gap.count("\n") < 2 else 1.0
    if sum(c in "\n\x85\u2028\u2029" for c in gap.replace("\r\n", "\n").replace("\r", "\n")) > 1:
        return 2.0
    line = text.rfind("\n", 0, start) + 1
    head = text[sentence] if sentence < len(text) else ""
    case = _case(text, end, "")
    last = text[max(line, start - 30) : start].split()
    tied = bool(last) and last[-1].casefold() in TIED
    stop = end
    while stop < len(text) and not text[stop].isspace():
        stop += 1
    spaceless = bool(_SPACELESS.match(text[end])) if end < len(text) else False
    width = max(start - line, len(_LINE.match(text, end).group()), start - line if line < 2 else line - 1 - (max(text.rfind("\n", 0, line - 1), text.rfind("\r", 0, line - 1)) + 1))
    following = 1 if spaceless and not "฀" <= text[end] <= "໿" else stop - end + 1
    full = start - line + following > width
    if tied:
        return -2.0
    left = text[start - 1]
    if _SPACELESS.match(left) and not "฀" <= left <= "໿":
        tail = _lattice(_run(text, sentence, start) or left, False)
        if tail[-1] in CJK_FINAL:
            return 2.0
        return -2.0 if tail[-1] in CJK_BEFORE else (-0.5 if full and midline else 1.5)
    begun = _PIECES.match(text, end)
    if case == "lower" and not head.islower() and not begun:
        return -2.0
    if full and (midline or case == "none" and not spaceless and t.flows(start)):
        return -1.5
    return -0.5 if full and case in ("lower", "digit") else 1.5


def split(text: str, opens: frozenset[str] = OPENS) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points, outer white space left out; ``opens`` are words that open sentences."""
    gone = [] if text.isascii() else [m.start() for m in _IGNORED.finditer(text)]
    place = None
    if gone:
        dropped = set(gone)
        place = [i for i in range(len(text)) if i not in dropped]
        text = "".join(text[i] for i in place)
    out = _split(text, opens)
    if place is None:
        return out
    return [(place[a], place[b - 1] + 1) for a, b in out]


def _candidates(t: _Text) -> list[tuple[int, int, str]]:
    """Places (start, end, kind) where a sentence may end, in order."""
    text = t.text
    found = [(m.start(), m.end(), "mark") for m in _MARKS.finditer(text)]
    if _NEWLINE.search(text):
        found += [(m.start(), m.end(), "break") for m in _BREAK.finditer(text)]
    if text and max(text) >= "\u0e00" and _SPACELESS.search(text):
        found += [(m.start(), m.end(), "gap") for m in _THAI_GAP.finditer(text)]
        found += [(m.start(), m.end(), "gap") for m in _CJK_GAP.finditer(text)]
        found.sort()
    elif len(found) > 1:
        found.sort()
    return found


class _Path:
    """A division of the text so far: its evidence, where its last sentence starts, and what the last line and mark were."""

    __slots__ = ("total", "sentence", "marked", "line", "ends")

    def __init__(self, total: float, sentence: int, marked: int, line: int, ends: tuple | None) -> None:
        self.total, self.sentence, self.marked, self.line, self.ends = total, sentence, marked, line, ends


def _closed(t: _Text, end: int) -> tuple[int, int | None]:
    """Where the closers after a mark end, and the last of them."""
    text, stop, closed = t.text, end, None
    while stop < len(text):
        c = text[stop]
        if c in CLOSERS and stop in t.quote:
            closed, stop = stop, stop + 1
        elif c in "\u0020\u00a0\u202f" and stop + 1 < len(text) and text[stop + 1] in "»" and stop + 1 in t.quote:
            closed, stop = stop + 1, stop + 2
        elif c in ENDS and closed is not None:
            stop += 1
        else:
            break
    return stop, closed


def _run(text: str, low: int, at: int) -> str:
    """The run without blanks and clause marks that ends at a place."""
    m = _WORDS_BEFORE.match(text, low, at)
    return m.group() if m else ""


def _last(text: str) -> str:
    """The last word of a short text."""
    words = text.split()
    return words[-1] if words else ""


def _gap(t: _Text, start: int, end: int, sentence: int) -> float | None:
    """Evidence that a gap in a spaceless script ends a sentence: final particles before it, opening words after it."""
    text = t.text
    left = text[start - 1]
    if left in ENDS:
        return None
    if "\u0e00" <= left <= "\u0e7f":
        tail, head = _lattice(_run(text, sentence, start), True), _lattice(_AHEAD.match(text, end).group(), True)
        if tail and tail[-1] in THAI_FINAL:
            return -1.0 if head and head[0] in ON else 2.0
        # without a particle, only what closes a statement before what opens one
        return 0.5 if tail and head and tail[-1] in THAI_CLOSES and head[0] in THAI_OPENS and len(tail) > 2 else -2.0
    tail, head = _lattice(_run(text, sentence, start), False), _lattice(_AHEAD.match(text, end).group(), False)
    return 1.0 if tail and head and tail[-1] in CJK_FINAL and len(tail) > 2 and head[0] in CJK_OPENS else -2.0


def _break(t: _Text, path: _Path, start: int, end: int, line: int, inside: int) -> float | None:
    """Evidence that a line break ends a sentence; None where a mark before it has decided or speech goes on over it."""
    text, sentence = t.text, path.sentence
    previous = text[max(line, sentence) : start].strip()
    spoken = _last(previous).casefold()
    if _LIST.match(text, end) and not (_NUMBERED.match(text, end) and (spoken in TIED or spoken.endswith(".") and spoken.rstrip(".") in NUMBER)):
        return 3.0
    if path.marked >= start - 1 and path.marked == len(text[:start].rstrip()) or inside >= end:
        return None
    tail = _run(text, sentence, start)
    if tail and "\u0e00" <= tail[-1] <= "\u0e7f" and _lattice(tail, True)[-1] in THAI_FINAL:
        return 2.0
    if _EMOJI_RUN.fullmatch(_last(text[max(0, start - 6) : start]) or "x"):
        return 1.5
    return _line_break(t, start, end, sentence, path.line == line)


def _plain(text: str, start: int, end: int, sentence: int) -> bool:
    """Whether a mark needs no further look, as :func:`_mark` gives 2: a wide one between letters, others before a capitalised word."""
    if end - start != 1 or start <= sentence:
        return False
    if text[start] in WIDE:
        return text[start - 1].isalpha() and text[end : end + 1].isalpha()
    if text[end : end + 1] != " " or not text[end + 1 : end + 2].isupper() or not text[end + 2 : end + 3].islower():
        return False
    if text[start] in "!?":
        return text[start - 1].isalpha()
    if text[start] != "." or start - sentence < 8:
        return False
    token = _TOKEN.match(text, max(sentence, start - 60), start)
    word = token.group() if token else ""
    return len(word) > 5 and word.isalpha() and word.casefold() not in ROLES and text[start - len(word) - 2] != "." and not _PIECE.match(text, end + 1)


def _split(text: str, opens: frozenset[str]) -> list[tuple[int, int]]:
    t = _Text(text, opens)
    pairs = sorted(t.inside)
    paths = [_Path(0.0, _skip(text, 0), -1, -1, None)]
    block, around, lined = 0, [], "\n" in text or "\r" in text
    for start, end, kind in _candidates(t):
        while block < len(pairs) and pairs[block][0] <= start:
            around.append(pairs[block])
            block += 1
        if around:
            around = [p for p in around if p[1] > start]
        if kind == "break":
            if end >= len(text):
                continue
        elif text[start] == "." and end - start == 1 and text[end : end + 1].isdigit() and text[start - 1 : start].isdigit():
            continue  # within a number
        line = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1 if lined else 0
        alone = paths[0] if len(paths) == 1 else None
        if alone is not None:
            if start < alone.sentence:
                continue
            if kind == "mark" and not around and _plain(text, start, end, alone.sentence):
                alone.total, alone.sentence, alone.marked, alone.line, alone.ends = alone.total + 2.0, _skip(text, end), end, line, (end, alone.ends)
                continue
        stop, closed = _closed(t, end) if kind == "mark" else (start, None)
        further: list[_Path] = []
        for path in paths:
            if start < path.sentence:
                further.append(path)
                continue
            # speech and remarks that began in this sentence hold it together
            inside = max((b for a, b in around if a >= path.sentence), default=-1) if around else -1
            at = stop
            if kind == "mark":
                score = _mark(t, start, end, stop, closed, path.sentence) if inside < stop else None
            elif kind == "gap":
                score = _gap(t, start, end, path.sentence) if inside < end else None
            else:
                score = _break(t, path, start, end, line, inside)
            if score is None:
                further.append(path)
                continue
            if score > -MARGIN / 2:
                if kind != "break":
                    m = _emoji(text, at)
                    at = m.end() if m else at
                after = _Path(path.total + score, _skip(text, at), at if kind == "mark" else path.marked, path.line if kind == "break" else line, (at, path.ends))
                further.append(after)
            if score < MARGIN / 2:
                path.total -= score
                path.marked = stop if kind == "mark" else path.marked
                further.append(path)
        if len(further) > 1:
            # paths whose sentence starts alike have one future: the better stays, as do those not far behind the best
            best: dict[int, _Path] = {}
            for p in further:
                if p.sentence not in best or best[p.sentence].total < p.total:
                    best[p.sentence] = p
            top = max(p.total for p in best.values())
            further = [p for p in best.values() if p.total > top - MARGIN]
        paths = further
    ends: list[int] = []
    last = max(paths, key=lambda p: p.total).ends
    while last is not None:
        ends.append(last[0])
        last = last[1]
    out, at = [], 0
    for end in [*reversed(ends), len(text)]:
        a = _skip(text, at)
        b = end
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            # a piece without any letter, digit or picture belongs to the sentence before it
            if out and not _SHOWN.search(text, a, b):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        at = max(at, end)
    return out


def _skip(text: str, at: int) -> int:
    size = len(text)
    if at >= size or not text[at].isspace():
        return at
    at += 1
    if at < size and not text[at].isspace():
        return at
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _mark(t: _Text, start: int, end: int, stop: int, closed: int | None, sentence: int) -> float | None:
    """Evidence that the marks at ``start`` .. ``end``, with closers up to ``stop``, end a sentence; None if they are no such marks."""
    text, marks = t.text, t.text[start:end]
    core = marks.replace(" ", "").replace(" ", "")
    if set(core) <= {";", ";"}:
        # the question mark of Greek
        left = text[start - 1] if start else ""
        if not (left and "GREEK" in unicodedata.name(left, "")):
            return None
        core = "?"
    if stop >= len(text):
        return 2.0
    m = _emoji(text, stop)
    after = _skip(text, m.end() if m else stop)
    if after >= len(text):
        return 2.0
    gap = text[stop].isspace()
    if sentence == start and not closed:
        return -1.0  # nothing before the marks
    if gap and end - sentence <= 6 and _NUMBERED.fullmatch(text, sentence, end):
        return -3.0  # the number of a list entry
    if m:
        return 2.0
    nxt = text[after]
    if nxt in ",，、;:؛،)）]":
        return -3.0
    if nxt in "—–" and core[-1] not in WIDE:
        return -2.0
    if closed is not None:
        score = _after_speech(t, closed, after, sentence, gap)
        if text[t.quote[closed]] not in BRACKETS and core == "." and score > 0:
            m = _TOKEN.match(text, max(sentence, start - 30), start)
            roles = _abbreviation(m.group() if m else "", "")
            if roles & {"maybe", "never"} and _case(text, after, "") != "upper":
                return -1.0
        return score
    if core in (".",):
        if not gap:
            left, right = text[start - 1], text[end]
            chunk = (text[max(sentence, start - 40) : start].split() or [""])[-1]
            if _ADDRESS.search(chunk.casefold() + "."):
                if not (right.isupper() and chunk != chunk.upper() and not chunk.casefold().endswith("www")):
                    return None
            if left.isdigit() and right.isdigit():
                return None
            run = _RUN.match(text, max(sentence, start - 30), start)
            size = len(run.group()) if run else 0
            if right in '"«„“‚‘¿¡(（' and not left.isspace() or right == "'" and end not in t.quote and text[end + 1 : end + 2].isupper():
                return _full_stop(t, start, end, after, sentence)
            if right.isupper() and (left.islower() and size > 1 or left.isdigit() or not left.isalnum() and left not in ".-"):
                token = _TOKEN.match(text, max(sentence, start - 60), start)
                roles = _abbreviation(token.group() if token else "", "")
                return -2.0 if roles & {"never", "letters"} else 1.5
            if right.isupper() and left.isupper() and size > 2:
                return 0.5 if _next_word(text, after) in t.opens or len(_next_word(text, after)) > 3 else -1.0
            if right.isalpha() and not _CASED.match(right) and left.isalpha() and size > 1 and not _SPACELESS.match(right) and _abbreviation(run.group(), "") == set():
                return 1.5
            if left.isdigit() and right.isalpha() and not _CASED.match(right) and not _SPACELESS.match(right):
                return 1.5
            return None
        return _full_stop(t, start, end, after, sentence)
    if set(core) <= {".", "…"}:
        return _pause(t, start, after, sentence, core)
    if core[-1] not in WIDE and not gap:
        token = text[max(0, start - 60) : start].split()
        if token and _ADDRESS.search(token[-1] + text[end : end + 20].split()[0]) or (token and "/" in token[-1]):
            return None
    if not text[sentence:start].strip("¿¡"):
        return -1.0
    return 2.0


_OPENER = "(?U)(?:^|[.!?\u2026\u061f\u0964][\"\u00bb\u201d]?\\s+)(\\p{Lu}[\\p{L}\\p{M}'\u2019]*)"


def opening_words(texts: DataFrame, column: str) -> frozenset[str]:
    """Words that open at least the share ``OPENING`` of all sentences of the corpus that an upper-case letter shows to begin.

    Counted over all texts, as often as they come, in the JVM with partial aggregation; by the share there are at most 1 / OPENING of them.
    """
    found = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(_OPENER), F.lit(1))).alias("w"))
    counted = scratch.written(found.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n")), "openings")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where((F.col("n") > 1) & (F.col("n") >= total * OPENING))
    # what also ties words together, as prepositions do, is no evidence
    return frozenset(r.w for r in often.collect()) - TIED


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_pos INT, end_pos INT)``: one row per sentence of every text, in code points from 0, the end exclusive.

    Outer white space is left out, and every visible character belongs to exactly one sentence. Null, empty and blank texts
    have no rows; rows delivered twice count once; a text of any length is divided whole. Other columns are not read.
    """
    kind = documents.schema[key].dataType.simpleString()
    once = documents.select(F.col(key), F.col(text).cast("string").alias("text")).where(F.length("text") > 0).dropDuplicates([key])
    opens = OPENS | opening_words(documents.select(F.col(text).cast("string").alias("text")), "text")

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            known: dict[str, list[tuple[int, int]]] = {}  # copied texts are divided once
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = known.get(t)
                if found is None:
                    found = known[t] = split(t, opens)
                rows += [i] * len(found)
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_pos", "end_pos"])

    return once.mapInArrow(divide, f"`{key}` {kind}, start_pos int, end_pos int")

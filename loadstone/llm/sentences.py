"""Sentence units of texts in many languages and scripts, by a finite transducer with parallel composition.

The boundary rules are compiled into a table: state and symbol give the next state and whether a unit begins at the
symbol. States keep what the past means for the next mark (inside a quotation of some kind, inside a parenthesis, behind an
end mark, behind an abbreviation that may end a sentence); symbols classify marks and the words behind them. A text's
symbols are cut into chunks; all chunks step at the same time for every possible state at once, so each becomes a function
from state to state; a prefix scan composes the functions; a last pass writes the boundaries from each chunk's true state.
So a single long document is worked on as widely as many short ones. Lines that are units by their layout (list items, log
lines, table rows) are found beforehand and reset the transducer. Everything runs on arrays of whole batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadstone.llm import spans
from loadstone.llm.starters import Learned, learn

# --- fixed values: word lists -----------------------------------------------------------------------------------------

#: Abbreviations that never end a sentence.
NEVER = """IN C.F.R Mr Mrs Ms Mx Dr Prof Sgt Capt Lt Col Gen Maj Cpl Gov Rep Sen Rev Hon Pres Supt Insp Messrs St Ste Ft Mt SGT CAPT LT MR MS DR ST FT MT
C.F.R i.e e.g cf ca approx vs v viz al. insp med wt rt lt lft Adj adj ADJ REF VIOL deg Temp temp min max para Sec Fig Figs Hwy Rte Lvl lvl eff est dept Dept Fa
Sr Sra Srta Dra Dr Av Avda aprox pág págs art EE bât env ex Mme Mlle vgl Abs bzw Nr Str evtl ggf geb Hr Fr inkl exkl zzgl
ул инж См см рис стр гл пр просп пер им акад проф тел обл ср напр κ π.χ αρ βλ σελ κα د أ م डॉ रु सं श्री प्रो""".split()
#: Abbreviations that don't end a sentence if a number follows.
BEFORE_NUMBER = """No Nos no nos NO NOS Nr Nrs p pp P PP S s n N No num Num vol Vol ch Ch Art Tab tab fig Abb ann Bd Nº nº
Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec JAN FEB MAR APR JUN JUL AUG SEP SEPT OCT NOV DEC д кв №""".split()
#: Abbreviations that end a sentence if what follows looks like the beginning of one.
MAYBE = """Inc Ltd Corp Co LLC Bros INC LTD CORP CO Jr JR SR etc ETC al a.m p.m A.M P.M am pm hrs hr HRS lbs lb LBS LB oz gal bu in ft yd mi sq cu t
UU mil bil dz doz pct Ph.D M.D B.A M.A Esq dept Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun usw Std Mio Mrd Tsd Ud Uds Jh
ч т г руб коп млн млрд тыс кг кв.м др пр κ.λπ κλπ κ.ά ώ รศ น""".split()
#: Names that contain an end mark; further ones are learned from the corpus (starters.py), as are words that begin sentences.
NAMES_WITH_MARKS = ("Yahoo", "Jeopardy", "Yum", "Which", "Westward Ho", "OK", "Mamma Mia", "Moulin Rouge")
#: Words that begin sentences; they tell an abbreviation or initial that ends a sentence from one within a name.
STARTERS = """The A An This That These Those It He She They We I You His Her Their Its Our My One Two Three Four Five Six Seven Eight Nine Ten
In On At By For From With Without To Of Under Over After Before During Since Until While When Where Why Who What Which How If Although Though Because As
And But Or So Yet Nor Not No Nobody Nothing None Some Any All Most Many Several Few Each Every Both Other Others Another Such There Here Then Now Today
Yesterday Tomorrow Did Do Does Is Are Was Were Has Have Had Can Could May Might Will Would Should Shall Must Mr Mrs Ms Dr Sgt Capt Lt Gov Rep Prof
Only According Per See Twas
Der Die Das Ein Eine Wir Ich Sie Es Er Im Am Laut Herr Frau Bitte Le La Les Un Une Il Elle Nous Selon El Los Las Una Según Se No Nadie""".split()
#: Capitalised words that go on after a time or an abbreviation.
GOING_ON = """KG KGaA Terminal Plant Division Group Holdings Building Monday Tuesday Wednesday Thursday Friday Saturday Sunday EST EDT CST CDT MST MDT PST PDT UTC GMT Eastern Central Mountain Pacific
Uhr Euro""".split()
#: Words before an ordinal number that is written with a point.
BEFORE_ORDINAL = "im am Am Im vom Vom zum Zum beim Beim den der dem des Der Den Dem ab Ab bis Bis seit Seit".split()
#: Words that begin a numbered heading.
HEADINGS = "SECTION Section CHAPTER Chapter PART Part ARTICLE Article ANNEX Annex Kapitel Abschnitt Artikel Chapitre Capítulo Sección Глава Раздел Статья Teil"

# --- character classes --------------------------------------------------------------------------------------------------

_KINDS = """SPACE LOW UP DIGIT HAN KANA HANGUL THAI LETTER MARK DOT ELLIPSIS SHOUT STOP DQUOTE APOSTROPHE CURLY_OPEN CURLY_CLOSE LOW_OPEN GUIL_OPEN
GUIL_CLOSE CORNER_OPEN CORNER_CLOSE PAREN_OPEN PAREN_CLOSE COMMA DASH AND INVERTED EMOJI OTHER SEMICOLON""".split()
K = {name: i for i, name in enumerate(_KINDS)}
_SINGLE = {
    "DOT": ".．｡", "ELLIPSIS": "…⋯", "SHOUT": "!?؟！？‼⁇⁈⁉‽;", "STOP": "。।॥۔؞։።᙮៕", "DQUOTE": '"', "APOSTROPHE": "'’‘", "CURLY_OPEN": "“‟", "CURLY_CLOSE": "”〞",
    "LOW_OPEN": "„", "GUIL_OPEN": "«‹", "GUIL_CLOSE": "»›", "CORNER_OPEN": "「『《〈【｢", "CORNER_CLOSE": "」』》〉】｣", "PAREN_OPEN": "([{（［｛", "PAREN_CLOSE": ")]}）］｝",
    "COMMA": ",:،؛，、：；", "DASH": "-–—―‐‑", "AND": "&+/＆", "INVERTED": "¡¿", "SEMICOLON": ";",
}


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    letters = {"Ll": "LOW", "Lu": "UP", "Lt": "UP", "Mn": "MARK", "Mc": "MARK", "Me": "MARK", "Nd": "DIGIT", "Nl": "DIGIT", "No": "DIGIT", "Lo": "LETTER", "Lm": "LETTER", "So": "EMOJI", "Sk": "OTHER"}
    table = np.fromiter((K[letters.get(unicodedata.category(chr(i)), "OTHER")] for i in range(0x110000)), np.uint8, 0x110000)
    letter = table == K["LETTER"]
    for kind, areas in {
        "HAN": ((0x3005, 0x3008), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)),
        "KANA": ((0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)),
        "HANGUL": ((0x1100, 0x1200), (0x3130, 0x3190), (0xA960, 0xA980), (0xAC00, 0xD800)),
        "THAI": ((0x0E00, 0x0F00),),
    }.items():
        for a, b in areas:
            table[a:b][letter[a:b]] = K[kind]
    table[0x0E30:0x0E5B] = np.where(table[0x0E30:0x0E5B] == K["DIGIT"], K["DIGIT"], K["THAI"])
    table[0x1F000:0x20000] = K["EMOJI"]
    table[[0x200D, 0xFE0E, 0xFE0F, 0x20E3]] = K["EMOJI"]
    table[[0x2116, 0xB0, 0xA9, 0xAE, 0x2122, 0xB6, 0xA6]] = K["OTHER"]
    table[[0xAA, 0xBA]] = K["LOW"]
    for kind, text in _SINGLE.items():
        table[[ord(c) for c in text]] = K[kind]
    table[[i for i in range(0x3100) if chr(i).isspace()] + [0x200B, 0xFEFF]] = K["SPACE"]
    return table


# --- the transducer -------------------------------------------------------------------------------------------------------

_SYMBOLS = """RESET SPACE UP STARTER GOES_ON LOW LOW_STARTER DIGIT CASELESS KANA HANGUL THAI_START END MAYBE RARELY ELLIPSIS NONE DQUOTE SQUOTE_OPEN SQUOTE_CLOSE
CURLY_OPEN CURLY_CLOSE LOW_OPEN GUIL_OPEN GUIL_CLOSE CORNER_OPEN CORNER_CLOSE PAREN_OPEN PAREN_CLOSE COMMA DASH AND INVERTED EMOJI OTHER""".split()
S = {name: i for i, name in enumerate(_SYMBOLS)}

_QUOTES = ("dq", "sq", "curly", "low", "guil", "corner")
_OPENS = {"DQUOTE": "dq", "SQUOTE_OPEN": "sq", "CURLY_OPEN": "curly", "LOW_OPEN": "low", "GUIL_OPEN": "guil", "CORNER_OPEN": "corner"}
_CLOSES = {"dq": ("DQUOTE",), "sq": ("SQUOTE_CLOSE",), "curly": ("CURLY_CLOSE",), "low": ("CURLY_OPEN", "CURLY_CLOSE"), "guil": ("GUIL_CLOSE",), "corner": ("CORNER_CLOSE",)}
_ENDS = {"END": "end", "MAYBE": "maybe", "RARELY": "rarely", "ELLIPSIS": "ellipsis"}
_CLOSERS = {"SQUOTE_CLOSE", "CURLY_CLOSE", "GUIL_CLOSE", "CORNER_CLOSE", "PAREN_CLOSE"}
_WORDS = {"UP", "STARTER", "GOES_ON", "LOW", "LOW_STARTER", "DIGIT", "CASELESS", "KANA", "HANGUL", "THAI_START", "OTHER", "INVERTED", "AND", "COMMA", "DASH", "NONE", "EMOJI"}


def _begin(symbol: str, at_start: bool) -> str:
    """The state behind a symbol that is read as part of running text."""
    if symbol in _OPENS:
        return f"{_OPENS[symbol]}:"
    if symbol == "PAREN_OPEN":
        return "paren_first:" if at_start else "paren_within:"
    if symbol in _ENDS:
        return f"{_ENDS[symbol]}:tight"
    return "text"


def _splits(pending: str, spaced: bool, symbol: str) -> bool | None:
    """Whether a unit begins at `symbol` behind a pending end; None: the end stays pending."""
    if symbol in _CLOSERS or symbol == "EMOJI" or symbol in _ENDS:
        return None
    if symbol in ("COMMA", "AND", "NONE") or (symbol == "DASH" and pending != "end"):
        return False
    if symbol == "DASH":
        return False
    opener = symbol in _OPENS or symbol in ("PAREN_OPEN", "INVERTED")
    if pending == "maybe":
        return spaced and (symbol in ("UP", "STARTER", "LOW_STARTER", "DIGIT", "CASELESS", "HANGUL", "KANA", "THAI_START", "OTHER") or (opener and symbol != "PAREN_OPEN"))
    if pending == "rarely":
        return spaced and (symbol in ("STARTER", "LOW_STARTER", "DIGIT", "CASELESS", "HANGUL", "THAI_START", "OTHER") or (opener and symbol != "PAREN_OPEN"))
    if pending == "ellipsis":
        return symbol != "LOW" and symbol != "PAREN_OPEN" and (spaced or symbol not in ("KANA",))
    if pending == "quoted":
        return symbol not in ("LOW", "PAREN_OPEN") and (spaced or symbol not in ("KANA", "HANGUL", "DIGIT", "OTHER", "GOES_ON"))
    # a plain end mark
    if not spaced and symbol == "LOW":
        return False
    return True


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The rules as tables: next state and boundary bit by symbol and state, and the states' names."""
    states = ["start", "text"]
    states += [f"{p}:{s}" for p in ("end", "maybe", "rarely", "ellipsis", "quoted") for s in ("tight", "spaced")]
    states += [f"{q}:{e}" for q in (*_QUOTES, "paren_first", "paren_within") for e in ("", "ended")]
    number = {s: i for i, s in enumerate(states)}
    nexts = np.zeros((len(_SYMBOLS), len(states)), np.uint8)
    bits = np.zeros_like(nexts)
    for symbol, y in S.items():
        for state, x in number.items():
            kind, _, rest = state.partition(":")
            new, bit = state, False
            if symbol == "RESET":
                new = "start"
            elif state in ("start", "text"):
                if symbol == "SPACE":
                    new = state
                elif symbol == "THAI_START":
                    new, bit = "text", state == "text"
                elif symbol in _ENDS and state == "start":
                    new = f"{_ENDS[symbol]}:tight"
                else:
                    new = _begin(symbol, state == "start")
            elif kind in ("end", "maybe", "rarely", "ellipsis", "quoted"):
                if symbol == "SPACE":
                    new = f"{kind}:spaced"
                else:
                    split = _splits(kind, rest == "spaced", symbol)
                    if split is None:
                        new = f"{_ENDS[symbol]}:tight" if symbol in _ENDS and not (kind == "end" and symbol != "ELLIPSIS") else state
                    elif split:
                        new, bit = _begin(symbol, True), True
                    else:
                        new = _begin(symbol, False)
            elif kind in _QUOTES:
                if symbol in _CLOSES[kind]:
                    new = "quoted:tight" if rest else "text"
                elif symbol in ("END", "MAYBE", "ELLIPSIS"):
                    new = f"{kind}:ended"
                elif symbol not in ("SPACE", "EMOJI") and symbol not in _CLOSERS:
                    new = f"{kind}:"
            else:  # in a parenthesis
                if symbol == "PAREN_CLOSE":
                    new = "end:tight" if rest and kind == "paren_first" else "text"
                elif symbol in ("END", "MAYBE", "ELLIPSIS"):
                    new = f"{kind}:ended"
                elif symbol not in ("SPACE", "EMOJI", "DQUOTE") and symbol not in _CLOSERS:
                    new = f"{kind}:"
            nexts[y, x], bits[y, x] = number[new], bit
    return nexts, bits, states


CHUNK = 64


def transduce(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The boundary bit of each symbol, beginning in the state "start"."""
    nexts, bits, states = transducer()
    n, k = len(symbols), len(states)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, S["SPACE"], np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(rows, chunk).T.copy()
    # every chunk as a function from state to state, all chunks and states at once
    functions = np.broadcast_to(np.arange(k, dtype=np.uint8), (rows, k)).copy()
    flat, width = nexts.ravel(), np.int32(k)
    for y in grid:
        functions = flat[(y.astype(np.int32) * width)[:, None] + functions]
    # inclusive prefix scan by doubling: after a step each row holds the composition of twice as many chunks
    reach = 1
    while reach < rows:
        functions[reach:] = np.take_along_axis(functions[reach:], functions[:-reach], axis=1)
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = functions[:-1, states.index("start")]
    out = np.empty((chunk, rows), np.uint8)
    flat_bits = bits.ravel()
    for i, y in enumerate(grid):
        at = y.astype(np.int32) * width + state
        out[i] = flat_bits[at]
        state = flat[at]
    return out.T.ravel()[:n].astype(bool)


# --- symbols of texts -----------------------------------------------------------------------------------------------------

_ITEM = re.compile(r"(?m)^[^\S\n]*(?:[-*•‣▪◦●·–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\)|\(?[ivxlIVXL]{1,5}\)|[①-⑳])[^\S\n]+(?=\S)")
_LOG = re.compile(r"(?m)^[^\S\n]*(?:\[?(?:\d{4}-\d\d-\d\d[ T])?[0-2]?\d:[0-5]\d(?::[0-5]\d)?\]?|[0-2]\d[0-5]\d)[^\S\n]+(?=\S)")
_HEADING = re.compile(rf"(?m)^[^\S\n]*(?:{'|'.join(HEADINGS.split())})\s+[\dIVXLC]+(?:\.\d+)*(\.)")
_DATE = re.compile(r"\d{4}(\.)\s{1,3}\d{1,2}(\.)\s{1,3}\d{1,2}(\.)(?=\s)")


@lru_cache(8)
def _named(learned: Learned) -> re.Pattern:
    names = dict.fromkeys((*NAMES_WITH_MARKS, *learned.names))
    return re.compile("|".join(rf"\b{re.escape(n).replace(chr(92) + ' ', chr(92) + 's+')}([!?])(?=\s)" for n in names))


@lru_cache(8)
def _lexicon(learned: Learned) -> dict[str, np.ndarray]:
    lists = {"NEVER": NEVER, "BEFORE_NUMBER": BEFORE_NUMBER, "MAYBE": MAYBE, "STARTERS": [*STARTERS, *learned.starters], "LOW_STARTERS": [*learned.low_starters, ""], "GOING_ON": GOING_ON, "BEFORE_ORDINAL": BEFORE_ORDINAL}
    return {k: np.sort(np.array([spans.word_hash(w) for w in dict.fromkeys(v)], np.uint64)) for k, v in lists.items()}


def _in(hashes: np.ndarray, name: str, learned: Learned = Learned()) -> np.ndarray:
    table = _lexicon(learned)[name]
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _last_true(flags: np.ndarray) -> np.ndarray:
    """For each position the last position up to it that is set, -1 if none."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each position the first position from it on that is set, the length if none."""
    n = len(flags)
    return np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1]


_TRIGGERS = np.array([x not in ("SPACE", "UP", "LOW", "DIGIT", "CASELESS", "KANA", "HANGUL", "NONE", "OTHER", "AND") for x in _SYMBOLS])
_PLAIN = {
    "SPACE": "SPACE", "LOW": "LOW", "UP": "UP", "DIGIT": "DIGIT", "HAN": "CASELESS", "KANA": "KANA", "HANGUL": "HANGUL", "THAI": "CASELESS", "LETTER": "CASELESS", "ELLIPSIS": "ELLIPSIS",
    "SHOUT": "END", "STOP": "END", "SEMICOLON": "COMMA", "APOSTROPHE": "LOW",
}
_SYMBOL_OF_KIND = np.array([S[_PLAIN.get(k, k if k in S else "NONE")] for k in K], np.uint8)


def unit_spans(points: np.ndarray, rows: np.ndarray, learned: Learned = Learned()) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every sentence unit in the code points of several texts; `rows` has the texts' offsets.

    Each text ends with a line feed.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[points]
    is_space = kind == K["SPACE"]
    solid = np.flatnonzero(~is_space)
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    # lines; a line feed behind a carriage return ends the same line
    returns = points == 13
    breaks = (points == 10) | returns | (points == 0x85) | (points == 0x2028) | (points == 0x2029) | (points == 11) | (points == 12)
    pairs = np.flatnonzero(returns[:-1] & (points[1:] == 10))
    breaks[pairs] = False
    plain = np.where(breaks, np.uint32(10), points)
    plain[pairs] = 32
    plain = plain.tobytes().decode("utf-32-le", "surrogatepass")
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    line_no = np.cumsum(np.concatenate([[False], breaks[:-1]]) | edge[:n])
    solid_line = line_no[solid]
    new_line = np.concatenate([[True], solid_line[1:] != solid_line[:-1]])
    first = solid[new_line]  # first character of each line that isn't blank
    line_of = solid_line[new_line]
    last = np.append(solid[np.flatnonzero(new_line)[1:] - 1], solid[-1])
    text_of = np.searchsorted(rows, first, "right")
    gap = np.concatenate([[True], (np.diff(line_of) > 1) | (np.diff(text_of) > 0)])  # the line begins a block

    def marked(pattern: re.Pattern) -> np.ndarray:
        at = np.fromiter((m.end() for m in pattern.finditer(plain)), np.int64)
        found = np.zeros(len(first), bool)
        if len(at):
            found[np.searchsorted(first, at, "right") - 1] = True
        return found

    colon = np.isin(points[last], [ord(":"), ord("：")])
    after_colon = np.concatenate([[False], colon[:-1]])
    bars = np.bincount(np.searchsorted(first, np.flatnonzero(points == ord("|")), "right") - 1, minlength=len(first)) if (points == 124).any() else np.zeros(len(first), int)
    row = bars[: len(first)] >= 2
    may_item, may_log = marked(_ITEM), marked(_LOG)

    def run_on(may: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Lines of runs of `may` that begin where allowed: lines hold on while each is one itself."""
        chained = _last_true(~may | begins)
        return may & (chained >= 0) & begins[np.maximum(chained, 0)]

    same_text = np.concatenate([[False], text_of[1:] == text_of[:-1]])
    next_log = np.append(may_log[1:] & ~gap[1:], False)
    item = run_on(may_item, may_item & (gap | after_colon | np.concatenate([[False], row[:-1]])))
    log = run_on(may_log, may_log & ((after_colon & same_text) | (gap & next_log)))
    laid_out = item | log | row
    behind_row = np.concatenate([[False], (row | log)[:-1]]) & ~laid_out
    forced = first[gap | laid_out | behind_row]
    quiet_lines = np.flatnonzero(laid_out)
    quiet = np.zeros(n, bool)
    quiet[spans.ranges(first[quiet_lines], last[quiet_lines] + 1 - first[quiet_lines])] = True

    # marks that end nothing by their form
    dead = np.zeros(n, bool)
    for pattern in (_HEADING, _DATE, _named(learned)):
        for m in pattern.finditer(plain):
            dead[[m.start(i) for i in range(1, m.re.groups + 1) if m.start(i) >= 0]] = True

    before = np.concatenate([[K["SPACE"]], kind[:-1]]).astype(np.uint8)
    before[edge[:n]] = K["SPACE"]
    after = np.append(kind[1:], K["SPACE"]).astype(np.uint8)
    after[np.maximum(rows[1:] - 1, 0)] = K["SPACE"]
    lettered = (kind >= K["LOW"]) & (kind <= K["MARK"]) & (kind != K["DIGIT"])
    next_solid = np.minimum(_next_true(~is_space), n - 1)
    symbol = _SYMBOL_OF_KIND[kind]
    semicolons = np.flatnonzero(kind == K["SEMICOLON"])
    if len(semicolons):  # the Greek question mark
        previous = points[np.maximum(semicolons - 1, 0)]
        greek = ((previous >= 0x370) & (previous < 0x400)) | ((previous >= 0x1F00) & (previous < 0x2000))
        symbol[semicolons[greek]] = S["END"]

    # points
    dots = np.flatnonzero(kind == K["DOT"])
    if len(dots):
        runs = (before[dots] == K["DOT"]) | (after[dots] == K["DOT"])
        symbol[dots[runs]] = S["ELLIPSIS"]
        d = dots[~runs]
        wordy = lettered | (kind == K["DOT"])
        start = _last_true(~wordy | edge[:n])[d - 1] if len(d) else d
        start = np.where(edge[np.maximum(start, 0)] & wordy[np.maximum(start, 0)], start, start + 1)
        start = np.where(d == 0, 0, np.minimum(start, d))
        start = np.where(edge[d], d, start)
        while len(start):  # leading points don't belong to the word
            lead = (start < d) & (kind[np.minimum(start, n - 1)] == K["DOT"])
            if not lead.any():
                break
            start = start + lead
        words = spans.span_hashes(points, start, d)
        # of a word with inner points that isn't listed as a whole, the last part counts
        inner = _last_true(kind == K["DOT"])[np.maximum(d - 1, 0)]
        cut = (inner >= start) & ~(_in(words, "NEVER") | _in(words, "MAYBE"))
        start[cut] = inner[cut] + 1
        words[cut] = spans.span_hashes(points, start[cut], d[cut])
        length = d - start
        b, a = before[d], after[d]
        follow = kind[next_solid[np.minimum(d + 1, n - 1)]]
        tight = (a != K["SPACE"]) & ((a <= K["MARK"]) | (a == K["AND"]) | (a == K["DASH"]) | (a == K["OTHER"]))
        result = np.full(len(d), S["END"], np.uint8)
        one = (length == 1) | ((length == 2) & (kind[d - 1] == K["MARK"]))
        one &= ~((start > 0) & (before[np.minimum(start, n - 1)] == K["AND"]))  # as the last of B/L
        upper = (b == K["UP"]) | ((b == K["MARK"]) & (kind[np.maximum(d - 2, 0)] == K["UP"]))
        result[one & upper] = S["RARELY"]
        result[one & (b == K["LOW"])] = S["NONE"]
        result[_in(words, "MAYBE")] = S["MAYBE"]
        result[_in(words, "NEVER")] = S["NONE"]
        result[_in(words, "BEFORE_NUMBER") & (follow == K["DIGIT"])] = S["NONE"]
        months = _in(words, "BEFORE_NUMBER") & (length > 2) & (follow != K["DIGIT"]) & upper_first(kind, start)
        result[months] = S["MAYBE"]
        result[b == K["THAI"]] = S["NONE"]  # Thai points only abbreviate
        numbers = b == K["DIGIT"]
        # an ordinal: a number behind certain words and before a capital
        digit_run = _last_true(kind != K["DIGIT"])[np.maximum(d - 1, 0)]
        word_end = _last_true(~is_space)[np.maximum(digit_run, 0)] + 1
        word_start = _last_true(~lettered)[np.maximum(word_end - 1, 0)] + 1
        ordinal = numbers & (digit_run >= 0) & (word_start < word_end) & (d - digit_run <= 3)
        if ordinal.any():
            h = spans.span_hashes(points, word_start[ordinal], word_end[ordinal])
            ordinal[ordinal] = _in(h, "BEFORE_ORDINAL")
            result[ordinal & (follow == K["UP"]) & ~tight] = S["NONE"]
        # no blank behind: an end only between a whole word and a capital or a caseless word
        capital = (a == K["UP"]) & ((b == K["LOW"]) | (b == K["MARK"]) | numbers | (b == K["PAREN_CLOSE"])) & (length != 1)
        nxt2 = np.append(kind[2:], [K["SPACE"], K["SPACE"]])[d]
        capital &= lettered[np.minimum(d + 2, n - 1)] | (nxt2 == K["SPACE"]) | (nxt2 == K["APOSTROPHE"])
        caseless = ((a == K["LETTER"]) | (a == K["HANGUL"])) & ((b == K["LETTER"]) | (b == K["HANGUL"]) | (b == K["MARK"])) & (length > 1)
        numbered = (a == K["DIGIT"]) & (b == K["LOW"]) & (length > 2)
        result[tight & ~capital & ~caseless & ~numbered] = S["NONE"]
        # addresses: a run without blanks that has an at sign or several inner points
        inside = tight & ((b <= K["MARK"]) & (b != K["SPACE"]))
        if inside.any():
            run = np.cumsum(is_space | edge[:n])
            at_signs = np.bincount(run[points == ord("@")], minlength=run[-1] + 1) if (points == ord("@")).any() else np.zeros(run[-1] + 1, int)
            many = np.bincount(run[d[inside]], minlength=run[-1] + 1)
            result[inside & ((many[run[d]] >= 2) | (at_signs[run[d]] > 0))] = S["NONE"]
        symbol[d] = result
    symbol[dead] = S["NONE"]

    # single quotation marks: pairs of which the second follows an end mark or comma; all others are apostrophes
    marks = np.flatnonzero(kind == K["APOSTROPHE"])
    if len(marks):
        opens = marks[np.isin(before[marks], [K["SPACE"], K["PAREN_OPEN"], K["DASH"]]) & (after[marks] <= K["LETTER"]) & (after[marks] != K["SPACE"])]
        closes = marks[np.isin(before[marks], [K["SHOUT"], K["DOT"], K["COMMA"], K["STOP"], K["ELLIPSIS"]]) & ~lettered[np.minimum(marks + 1, n - 1)]]
        if len(opens) and len(closes):
            j = np.searchsorted(opens, closes) - 1
            ok = j >= 0
            o, c = opens[j[ok]], closes[ok]
            blocks = first[gap]
            ok = (np.searchsorted(blocks, o, "right") == np.searchsorted(blocks, c, "right")) & (np.concatenate([[-1], o[:-1]]) != o)
            symbol[o[ok]], symbol[c[ok]] = S["SQUOTE_OPEN"], S["SQUOTE_CLOSE"]

    # which symbols matter: marks, what follows them, and the first of each forced unit
    triggers = _TRIGGERS[symbol]
    behind = np.zeros(n, bool)
    behind[1:] = triggers[:-1]
    last_solid = _last_true(~is_space)
    previous_solid = np.concatenate([[-1], last_solid[:-1]])
    follows = np.zeros(n, bool)
    has = previous_solid >= 0
    follows[has] = triggers[previous_solid[has]]
    thai = (kind == K["THAI"]) & (before == K["SPACE"]) & has & (kind[np.maximum(previous_solid, 0)] == K["THAI"]) & (after != K["DOT"])  # not before ก.ค.
    symbol[thai] = S["THAI_START"]
    is_forced = np.zeros(n, bool)
    is_forced[forced] = True
    keep = (triggers | (behind & is_space) | (follows & ~is_space) | thai | is_forced) & ~(quiet & ~is_forced)

    # words behind a mark: those that begin sentences, and those that go on
    heads = np.flatnonzero(keep & (symbol == S["UP"]) | keep & (symbol == S["LOW"]) & (kind == K["LOW"]))
    if len(heads):
        ends = _next_true(~lettered)[heads]
        h = spans.span_hashes(points, heads, np.maximum(ends, heads))
        up = symbol[heads] == S["UP"]
        initial = (ends - heads == 1) & (kind[np.minimum(ends, n - 1)] == K["DOT"])
        symbol[heads[up & ~initial & _in(h, "STARTERS", learned)]] = S["STARTER"]
        symbol[heads[up & _in(h, "GOING_ON")]] = S["GOES_ON"]
        camel = ~up & (after[heads] == K["UP"])
        symbol[heads[camel | (~up & _in(h, "LOW_STARTERS", learned))]] = S["LOW_STARTER"]

    at = np.flatnonzero(keep)
    resets = np.searchsorted(at, forced)
    stream = np.insert(symbol[at], resets, S["RESET"])
    bits = transduce(stream)
    bits = np.delete(bits, resets + np.arange(len(resets)))
    begins = is_forced.copy()
    begins[at[bits]] = True
    starts = np.flatnonzero(begins)
    ends = last_solid[np.append(starts[1:] - 1, n - 1)] + 1
    return starts, ends


def upper_first(kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    return kind[np.minimum(start, len(kind) - 1)] == K["UP"]


def sentence_units(df: DataFrame, text: str = "text", start: str = "start_char", end: str = "end_char", learned: Learned | None = None) -> DataFrame:
    """One row per sentence unit: the other columns of `df`, start and end as code-point positions (end exclusive).

    Units cover all of a text but white space and have none at their ends. Null, empty and blank texts and an empty table
    give no rows. A text of any length is worked on whole; repeated rows give repeated units. A column named as `start` or
    `end` raises ValueError. Words that begin sentences and names that hold a mark are learned from all texts first, unless
    `learned` gives them; the texts themselves aren't shuffled.
    """
    learned = learn(df, text) if learned is None else learned
    kept = [f for f in df.schema.fields if f.name != text]
    if {start, end} & {f.name for f in kept}:
        raise ValueError(f"the input already has a column {start} or {end}")
    schema = T.StructType([*kept, T.StructField(start, T.LongType()), T.StructField(end, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(text)
            rest = [i for i in range(batch.num_columns) if i != place]
            for a, _, data, offsets in spans.slices(batch.column(place)):
                points, _, rows = spans.code_points(data, offsets)
                points, rows = np.insert(points, rows[1:], 10), rows + np.arange(len(rows))  # a line ends with its text
                starts, ends = unit_spans(points, rows, learned)
                row = np.searchsorted(rows, starts, "right") - 1
                columns = [batch.column(i).take(pa.array(row + a)) for i in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(starts - rows[row]), pa.array(ends - rows[row])], names=schema.names)

    return df.mapInArrow(run, schema)

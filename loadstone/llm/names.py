"""Typed names of organisations and persons, parsed into a core and what may vary around it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

# --- fixed values: word lists -----------------------------------------------------------------------------------------

#: Lines of business of freight shippers: canonical word, then other spellings. Lines that aren't listed are learned from
#: the names themselves (lexicon.py).
BUSINESS = {
    "AGGREGATES": "AGGREGATES AGGREGATE AGG AGGR", "AUTOMOTIVE": "AUTOMOTIVE AUTO AUTOS MOTORS", "BAKERY": "BAKERY BAKERIES BAKING", "BEVERAGE": "BEVERAGE BEVERAGES BEV",
    "BREWING": "BREWING BREWERY BREWERIES", "CEMENT": "CEMENT CEM CMT CEMENTS", "CHEMICAL": "CHEMICAL CHEMICALS CHEM CHEML", "COAL": "COAL COKE COALS", "CONCRETE": "CONCRETE CONC",
    "CONSTRUCTION": "CONSTRUCTION CONSTR CONST BUILDERS", "COTTON": "COTTON GINNING", "DAIRY": "DAIRY DAIRIES DRY", "EGGS": "EGGS EGG", "ELECTRIC": "ELECTRIC ELECTRICAL ELEC", "ELECTRONICS": "ELECTRONICS ELECTRONIC",
    "FARMS": "FARMS FARM RANCH", "FEED": "FEED FEEDS FD MILLS MLS MILL", "FERTILIZER": "FERTILIZER FERTILIZERS FERT", "FOODS": "FOODS FOOD", "FOUNDRY": "FOUNDRY FOUNDRIES CASTINGS", "FURNITURE": "FURNITURE FURN FURNISHINGS",
    "GLASS": "GLASS GLS GLAS", "GRAIN": "GRAIN GRAINS GRN", "HARDWARE": "HARDWARE", "LIVESTOCK": "LIVESTOCK CATTLE HOGS", "LUMBER": "LUMBER LUMBR LBR", "MACHINERY": "MACHINERY MACHINE MACH MACHINES",
    "MEATS": "MEATS MEAT PKG PACKING", "MEDICAL": "MEDICAL MED", "MILLING": "MILLING MLG MILLNG", "MINING": "MINING MINES MINERALS", "NURSERY": "NURSERY NURSERIES", "OIL": "OIL OILS", "PACKAGING": "PACKAGING CONTAINER CONTAINERS",
    "PAINT": "PAINT PAINTS COATINGS", "PAPER": "PAPER PAPERS PPR", "PETROLEUM": "PETROLEUM PETRO PETROL PET", "PHARMA": "PHARMA PHARMACEUTICAL PHARMACEUTICALS PHARM", "PIPE": "PIPE TUBE PIPES TUBES TUBING",
    "PLASTICS": "PLASTICS PLASTIC PLAS PLAST PLSTC", "POULTRY": "POULTRY CHICKEN", "PRINTING": "PRINTING PRESS", "PRODUCE": "PRODUCE", "PROPANE": "PROPANE PROP GAS", "RECYCLING": "RECYCLING RECYC RECYCLERS RECYCLER",
    "REFINING": "REFINING REFIN REFNG REF REFINERY", "RUBBER": "RUBBER", "SAND": "SAND GRAVEL", "SCRAP": "SCRAP METAL METALS MTL SCRP", "SEAFOOD": "SEAFOOD SEAFOODS FISHERIES", "SEED": "SEED SEEDS", "STEEL": "STEEL STEELS STL",
    "STONE": "STONE QUARRY QUARRIES", "SUGAR": "SUGAR", "TEXTILES": "TEXTILES TEXTILE TEX", "TIMBER": "TIMBER LOGGING", "TIRE": "TIRE TIRES", "TOBACCO": "TOBACCO", "WINE": "WINE WINES WINERY VINEYARDS",
}
#: Words of the trade that stand beside the line of business.
TRADE = {
    "SUPPLY": "SUPPLY SUP SPLY SUPPLIES", "PRODUCTS": "PRODUCTS PRODS PRDTS", "MANUFACTURING": "MANUFACTURING MFG MANUF MFRG MANUFACTURERS", "INDUSTRIES": "INDUSTRIES INDS IND INDUSTRY",
    "INTERNATIONAL": "INTERNATIONAL INTERNATL INTL INT", "ASSOCIATES": "ASSOCIATES ASSOCS ASSOC", "DISTRIBUTION": "DISTRIBUTION DISTRIB DISTR DIST DISTRIBUTORS", "BROTHERS": "BROTHERS BROS",
    "SERVICES": "SERVICES SERVICE SVCS SVC SERV", "TERMINAL": "TERMINAL TERMINALS TERM TRML",
}
#: Words of listed companies' titles that stand beside the line of business.
TITLE_TRADE = "HOLDINGS HOLDING GROUP ENTERPRISES RESOURCES PARTNERS INDUSTRIES INTERNATIONAL".split()
LEGAL = "CO LLC INC CORP LTD COOP LIMITED COMPANY LIABILITY CORPORATION INCORPORATED COOPERATIVE LP LLP PLC TRUST NV SA".split()
#: Words before a name or behind it that aren't part of it.
NOISE = "THE MR MRS MS OWNER AND ATTN SHIPPING DOCK PLANT CARE OF DBA RECEIVING OFFICE DEPT DIV YARD UNIT GATE WAREHOUSE BLDG".split()
#: Names that name nobody.
PLACEHOLDERS = set("NONE NA N A SELF LINE RUN VARIOUS UNKNOWN UNK SHIPPER SAME MULTIPLE MISC VARIES TBD NO SEE BOL EMPTY BLANK TEST XXX SHIPPERS NOT LISTED APPLICABLE AVAILABLE PRIVATE INDIVIDUAL OTHER CUSTOMER BILL LADING".split())
#: Given names and their short forms.
GIVEN = {
    "FRANCISCO": "PACO PANCHO FRANK FCO CISCO", "SAMUEL": "SAM SAML SAMMY", "GUADALUPE": "LUPE LUPITA", "MICHAEL": "MIKE MICK MICKEY", "KATHERINE": "KATE KATHY KATIE KATH KAY",
    "PATRICIA": "PAT PATTY TRISH PATSY TRICIA", "DANIEL": "DAN DANNY DANL", "EDWARD": "ED EDDIE TED EDW NED TEDDY", "EUGENE": "GENE EUG", "KENNETH": "KEN KENNY", "ANTHONY": "TONY ANT",
    "BENJAMIN": "BEN BENJ BENNY", "NICHOLAS": "NICK NICKY NICHS", "JOSEPH": "JOE JOS JOEY", "ELIZABETH": "BETH BETTY LIZ ELIZ BETSY LIZZIE ELIZA BESS", "LAWRENCE": "LARRY LAWR LAURIE",
    "SUSAN": "SUE SUZY SUSIE SUZIE", "LEONARD": "LEN LENNY LEO LEON", "THOMAS": "TOM TOMMY THOS", "RICHARD": "RICK RICH DICK RICHD RICKY", "ROBERT": "BOB ROB BOBBY ROBT BERT",
    "WILLIAM": "BILL WILL WM BILLY WILLIE", "FREDERICK": "FRED FREDDY FREDDIE FREDK", "GERALD": "JERRY GERRY GER", "THEODORE": "TED THEO TEDDY", "DEBORAH": "DEB DEBBIE DEBBY",
    "JAMES": "JIM JIMMY JAS JAMIE", "CHARLES": "CHARLIE CHUCK CHAS CHARLEY", "ALEXANDER": "ALEX SANDY ALEC", "MARGARET": "MAGGIE PEGGY MEG MARG MARGE PEG", "JOHN": "JACK JOHNNY",
    "CHRISTOPHER": "CHRIS KIT", "STEPHEN": "STEVE STEVEN", "MATTHEW": "MATT", "ANDREW": "ANDY DREW", "DAVID": "DAVE", "RONALD": "RON RONNIE", "DONALD": "DON DONNIE", "TIMOTHY": "TIM",
    "JOSE": "PEPE", "MARIA": "", "ROSA": "ROSITA", "LUIS": "", "JUAN": "", "CARLOS": "", "PEDRO": "", "MIGUEL": "", "JORGE": "", "MANUEL": "MANNY", "ANTONIO": "", "FERNANDO": "", "ROBERTO": "BETO", "RICARDO": "", "EDUARDO": "", "JAVIER": "",
    "MUHAMMAD": "MOHAMMED MOHAMMAD MOHAMED", "AHMED": "AHMAD", "ALI": "", "HASSAN": "", "OMAR": "", "IBRAHIM": "", "FATIMA": "", "WEI": "", "MING": "", "JIAN": "", "YAN": "", "HIROSHI": "", "KENJI": "", "RAJESH": "RAJ", "SANJAY": "", "AMIT": "", "PRIYA": "", "ANIL": "", "NGUYEN": "",
    "MARK": "", "PAUL": "", "GEORGE": "", "BRIAN": "BRYAN", "KEVIN": "", "JASON": "", "ERIC": "ERIK", "SCOTT": "", "PETER": "PETE", "HENRY": "HANK", "WALTER": "WALT", "HAROLD": "HARRY HAL", "ARTHUR": "ART", "ALBERT": "BERTIE", "LOUIS": "LOU", "PHILIP": "PHIL PHILLIP", "DOUGLAS": "DOUG", "RUSSELL": "RUSS",
    "ROGER": "", "GARY": "", "LINDA": "", "MARY": "", "NANCY": "", "KAREN": "", "LISA": "", "SANDRA": "", "HELEN": "", "RUTH": "", "SHARON": "", "ANNA": "ANN ANNE", "LAURA": "", "CAROL": "", "DIANE": "", "JULIE": "JULIA", "MARTHA": "", "TERESA": "TERRY THERESA", "GLORIA": "", "SARAH": "SARA",
    "GREGORY": "GREG", "JEFFREY": "JEFF", "RAYMOND": "RAY", "JENNIFER": "JENNY JEN", "BARBARA": "BARB BARBIE", "REBECCA": "BECKY", "VICTORIA": "VICKY", "CATHERINE": "CATHY", "DOROTHY": "DOT DOTTIE",
}
SUFFIXES = {"JR": "JR", "SR": "SR", "JUNIOR": "JR", "SENIOR": "SR", "II": "II", "III": "III", "IV": "IV"}
PLACE_FIRST = set("NORTH SOUTH EAST WEST FORT FT MOUNT MT SAINT ST N S E W PORT LAKE NEW".split())
#: Digits that are mistaken for letters.
LOOKALIKES = str.maketrans("0185346", "OIBSEAG")

BUSINESS_OF = {w: c for c, ws in BUSINESS.items() for w in ws.split()}
TRADE_OF = {w: c for c, ws in TRADE.items() for w in ws.split()} | {w: w for w in TITLE_TRADE if w not in ("INDUSTRIES", "INTERNATIONAL")}
GIVEN_OF: dict[str, set[str]] = {}
for _name, _short in GIVEN.items():
    for _w in (_name, *_short.split()):
        GIVEN_OF.setdefault(_w, set()).add(_name)


def _deletions(word: str, most: int) -> set[str]:
    found, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found |= level
    return found


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance with neighbouring transpositions is at most k; only a band of the table is computed."""
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= k:
            row[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            y = b[j - 1]
            best = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        before, last = last, row
    return last[-1] <= k


class Fuzzy:
    """Finds the listed word that a misspelt one stands for, by common deletions and a check of the distance."""

    def __init__(self, words: Iterable[str], shortest: int = 4) -> None:
        self.words = {w for w in words if len(w) >= shortest}
        self.index: dict[str, set[str]] = {}
        for w in self.words:
            for d in _deletions(w, 2 if len(w) >= 7 else 1):
                self.index.setdefault(d, set()).add(w)

    def find(self, word: str) -> str | None:
        if word in self.words:
            return word
        if len(word) < 4:
            return None
        k = 2 if len(word) >= 7 else 1
        hits = {w for d in _deletions(word, k) for w in self.index.get(d, ())}
        for most in range(1, k + 1):
            ok = sorted(w for w in hits if (most == 1 or len(w) >= 7) and within(word, w, most))
            if ok:
                return ok[0]
        return None


@lru_cache(1)
def _fuzzy_words() -> Fuzzy:
    return Fuzzy([*(w for w in BUSINESS_OF if len(w) >= 5), *(w for w in TRADE_OF if len(w) >= 6), *(w for w in LEGAL if len(w) >= 7), "STEEL", "METAL", "GLASS", "GRAIN", "PAPER"])


@lru_cache(1)
def _fuzzy_short() -> Fuzzy:
    """Short words, looked for only behind a core that is long enough."""
    return Fuzzy([*(w for w in BUSINESS_OF if len(w) >= 4), *(w for w in TRADE_OF if len(w) >= 5), "PROD", "CORP"])


@lru_cache(100_000)
def later_class(word: str) -> tuple[str, str]:
    """word_class() for a word behind a long core: misspelt short words and two words in one are known too."""
    found = word_class(word)
    if found[0] or len(word) < 4 or word in PLACE_FIRST:
        return found
    near = _fuzzy_short().find(word)
    if near is None and len(word) >= 7:
        near = next((w for w in sorted(BUSINESS_OF) if len(w) >= 6 and within(word, w, 2)), None)
    if near is None:
        near = next((w for w in sorted(BUSINESS_OF, key=len, reverse=True) if len(w) >= 4 and word.startswith(w)), None)
    return word_class(near) if near else found


@lru_cache(1)
def _fuzzy_given() -> Fuzzy:
    return Fuzzy(GIVEN, 5)


def listed(word: str) -> bool:
    """Whether a word, digits read as letters, is on one of the lists."""
    plain = word.translate(LOOKALIKES)
    return any(w in table for w in (word, plain) for table in (BUSINESS_OF, TRADE_OF, LEGAL, NOISE)) or word == "PROD"


@lru_cache(200_000)
def word_class(word: str) -> tuple[str, str]:
    """Class and canonical form of a word: business, trade, legal, noise, or "" for any other word."""
    for table, name in ((BUSINESS_OF, "business"), (TRADE_OF, "trade")):
        if word in table:
            return name, table[word]
    if word in LEGAL:
        return "legal", word
    if word in NOISE:
        return "noise", word
    if word == "PROD":
        return "prod", word
    if word in PLACE_FIRST:
        return "", word
    plain = word.translate(LOOKALIKES)
    if plain != word and not word.isdigit():
        return word_class(plain)
    found = _fuzzy_words().find(word) if len(word) >= 4 else None
    if found:
        return {True: ("business", BUSINESS_OF.get(found, ""))}.get(found in BUSINESS_OF, ("trade", TRADE_OF[found]) if found in TRADE_OF else ("legal", found))
    return "", word


@lru_cache(100_000)
def given_names(word: str) -> frozenset[str]:
    """The given names that a word may stand for, misspelt or short; empty for any other word."""
    if word in GIVEN_OF:
        return frozenset(GIVEN_OF[word])
    plain = word.translate(LOOKALIKES)
    if plain in GIVEN_OF:
        return frozenset(GIVEN_OF[plain])
    found = _fuzzy_given().find(plain) if len(plain) >= 5 else None
    return frozenset([found]) if found else frozenset()


def fold(core: str) -> str:
    """A core without blanks and without what is easily confused: digits for letters, PH, Y, doubled letters."""
    s = core.replace(" ", "").translate(LOOKALIKES).replace("PH", "F").replace("Y", "I")
    return re.sub(r"(.)\1+", r"\1", s)


@dataclass
class Name:
    """A parsed name. kind: "org", "person" or "" (nobody); keys: folded cores, the first as written, others reordered; of an
    organisation words, the number of words of the core, first, the first word, and rest, the core behind it (null if too short)."""

    kind: str = ""
    keys: list[str] = field(default_factory=list)
    words: int = 0
    first: str | None = None
    rest: str | None = None
    business: str | None = None
    partial: str | None = None
    trade: str | None = None
    given: list[str] = field(default_factory=list)
    initial: str | None = None
    suffix: str | None = None


_LETTERS = re.compile(r"\b(L L C|I N C|C O O P|L T D|C O R P|L L P|L P GAS|LP GAS|CO OP|D B A|C O|P L C)\b")
_JOINED = {"L L C": "LLC", "I N C": "INC", "C O O P": "COOP", "L T D": "LTD", "C O R P": "CORP", "L L P": "LLP", "L P GAS": "PROPANE", "LP GAS": "PROPANE", "CO OP": "COOP", "D B A": "DBA", "P L C": "PLC"}


def normalized(text: str | None) -> str:
    """Upper case, every run of other characters than A-Z and 0-9 one blank, trimmed."""
    return re.sub(r"[^A-Z0-9]+", " ", (text or "").upper()).strip()


def _rotations(tokens: list[str]) -> list[str]:
    """Folded cores: as written; of three or more words in alphabetical order, the same whatever their order; and rotated, so
    that a typo that changes the alphabetical order of two to four words is met too."""
    keys = [fold("".join(tokens))] + [fold("".join(sorted(tokens)))] * (len(tokens) > 2)
    for i in range(1, min(len(tokens), 4)):
        keys.append(fold("".join(tokens[i:] + tokens[:i])))
    return list(dict.fromkeys(keys))


def _person(tokens: list[str]) -> Name | None:
    suffix = next((SUFFIXES[t] for t in tokens if t in SUFFIXES), None)
    rest = [t for t in tokens if t not in SUFFIXES]
    at = next((i for i, t in enumerate(rest) if t in GIVEN_OF and i in (0, len(rest) - 1, len(rest) - 2)), None)
    if at is None:
        at = next((i for i, t in enumerate(rest) if given_names(t)), None)
    if at is None and suffix and 2 <= len(rest) <= 3 and all(t.isalpha() for t in rest):
        at = 0  # an unlisted given name before a surname and a generation
    if at is None or len(rest) < 2:
        return None
    names = sorted(given_names(rest[at])) or [rest[at]]
    before, after = rest[:at], rest[at + 1 :]
    initial = None
    if sum(map(len, before)) >= 5:  # surname first
        surname = before
        if after and len(after[0]) == 1:
            initial = after[0]
    else:
        surname = before + after
        if not before and len(after) > 1 and len(after[0]) == 1:
            initial, surname = after[0], after[1:]
    if len("".join(surname)) < 4:
        return None
    return Name("person", [fold("".join(surname))], given=names, initial=initial, suffix=suffix)


def parse(text: str | None, learned: dict[str, str] | None = None) -> Name:
    """Parse a normalised name; null, empty and placeholder names give the kind "". `learned`: further words of lines of
    business with their canonical forms, as lexicon.learned_lines() finds them."""
    s = normalized(text)
    if not s or all(t in PLACEHOLDERS or t.isdigit() for t in s.split()):
        return Name()
    s = _LETTERS.sub(lambda m: _JOINED.get(m[1], " "), s)
    tokens = s.split()
    while tokens and tokens[0] in NOISE:
        tokens = tokens[1:]
    learned = learned or {}
    # a first word is mostly part of the core: it is taken for a listed one if it is spelt like it or a listed one follows
    classes = [("business", learned[t]) if t in learned else word_class(t) if i or listed(t) or listed("".join(tokens[1:2])) else ("", t) for i, t in enumerate(tokens)]
    known = {"business", "trade", "legal", "prod"}
    exact = [c[0] in known for c in classes]
    if not any(exact) or (any(t in SUFFIXES for t in tokens) and not any(c[0] == "business" for c in classes)):
        bare = [t for i, t in enumerate(tokens) if classes[i][0] != "noise" and not t.isdigit()]
        if (person := _person(bare)) is not None:
            return person
    # the core: words before the first known one; or, if a name begins with known words, those behind them
    first = next((i for i, ok in enumerate(exact) if ok), None)
    if first == 0:
        end = 0
        while end < len(tokens) and (exact[end] or classes[end][0] == "noise"):
            end += 1
        core = []
        for i in range(end, len(tokens)):
            if exact[i] or classes[i][0] == "noise":
                break
            core.append(tokens[i])
            if len(core) > 1 and len("".join(core)) >= 10:
                break
        trailing = tokens[end + len(core) :]
        described = classes[:end] + classes[end + len(core) :]
    else:
        length, cut = 0, len(tokens)
        for i, t in enumerate(tokens):
            # a short core ends where nothing but listed words and numbers follows
            if i and length >= 3 and not t.isdigit() and all(listed(x) or x in learned or x.isdigit() for x in tokens[i:]):
                cut = i
                break
            if i and length >= 8 and (classes[i][0] or later_class(t)[0] or (t in PLACE_FIRST and len(t) > 1 and i + 1 < len(tokens))):
                cut = i
                break
            length += len(t)
        core, trailing = tokens[:cut], tokens[cut:]
        described = [classes[cut + i] if classes[cut + i][0] else later_class(t) for i, t in enumerate(trailing)]
    partial = None
    if first != 0 and not trailing and len(core) > 1 and len("".join(core[:-1])) >= 8:
        tail = core[-1]
        if any(w.startswith(tail) for w in (*BUSINESS, *TRADE, *LEGAL)) and len(tail) < 9:
            core, partial = core[:-1], tail
    core = [t for t in core if not t.isdigit()]
    if not core or len("".join(core)) < 3:
        core = [t for t in tokens if t not in NOISE] or tokens
    business = next((c for k, c in described if k == "business"), None)
    trades = [c for k, c in described if k == "trade"]
    prod = any(k == "prod" for k, _ in described)
    if prod and business:
        trades.append("PRODUCTS")
    elif prod and not business:
        partial = "PROD"
    if business is None and partial is None and trailing:
        last = trailing[-1]
        if word_class(last)[0] == "" and any(w.startswith(last) for w in BUSINESS) and len(last) <= 9:
            partial = last
    keys, folded = _rotations(core), fold(tokens[0])
    rest = keys[0][len(folded) :] if keys[0].startswith(folded) and len(keys[0]) - len(folded) >= 4 else None
    return Name("org", keys, words=len(core), first=tokens[0], rest=rest, business=business, partial=partial, trade=trades[0] if trades else None)

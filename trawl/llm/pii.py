"""Problem 9: personal data in free text. Generators propose overlapping spans with high recall, boosted trees over format and context
features judge each span, and spans over the calibrated threshold of their type are taken, the surest first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.boost import Boosted
from trawl.storage import settings

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")

# --- generators -------------------------------------------------------------------------------------------------------
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪŁŃŇŐŒŘŚŞŠŤŪŮŰŹŻŽ", "a-zß-öø-ÿāăąćčďđēęěğīıłńňőœřśşšťūůűźżž̀-ͯ\u0080-¿‘-•€™ƒŸ"
_WORD = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}{_UP}]+(?:-[{_UP}][{_LOW}{_UP}]+)*"
_PARTICLE = r"(?:[Vv]an [Dd]e[rn] |[Vv]an |[Vv]on [Dd]er |[Vv]on |[Zz]u |[Tt]er |[Dd]e [Ll]a |[Dd]e |[Dd]el |[Dd]i |[Dd]a |[Ll]e |[Aa]l |[Bb]in |VAN DE[RN] |VAN |VON |TER |DE LA |DE |DEL )"
_NAME = re.compile(
    rf"(?<![\w.@/\\'’-])(?:(?P<comma>{_PARTICLE}?{_WORD}, {_WORD}(?: [{_UP}]\.)?)|(?P<full>{_WORD}(?: [{_UP}]\.)* {_PARTICLE}?{_WORD})|(?P<initial>(?:[{_UP}]\. ?)+{_PARTICLE}?{_WORD}))(?![\w@/\\(]|\.\w)"
)
_AT = r"(?:@|%40|＠|&#64;|\\u0040|\\x40|\\@|\s?[(\[{<]\s?(?:at|AT|ät)\s?[)\]}>]\s?| AT | at )"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|punkt|point|punto)\s?[)\]}>]\s?|\sdot\s|\sDOT\s)"
_EMAIL = re.compile(rf"(?P<at>{_AT})(?P<host>[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*)")
_DIGITS = re.compile(r"(?<![\w.,/#@%-])(?!\d{4}-\d\d-\d\d\b)(?:[A-Z]{1,2} ?(?=\d))?(?:\+ ?\(?|\(|00)?\d(?:[ ().\-/ ‐-–]{0,3}\d){5,17}(?: ?[A-Z])?(?![\w%@]|[-:/]\d|\.\d)")
_KIND = r"Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Close|Crescent|Row|Hill"
_ADDRESS = re.compile(
    rf"(?<![\w.,:/#-])(?:"
    rf"(?P<plain>(?:(?i:flat|unit|apt\.?|apartment|suite|room) \d+[A-Za-z]?,? )?\d{{1,5}}[A-Za-z]? (?:[NSEW]{{1,2}}\.? )?(?:{_WORD} ){{1,3}}(?:(?i:{_KIND})))(?![{_LOW}{_UP}])"
    rf"|(?P<german>{_WORD}(?:str\.|straße|strasse|STRASSE|STRAẞE|weg|platz|gasse|allee|damm|ring|ufer) ?\d{{1,4}} ?[a-z]?)(?!\w)"
    rf"|(?P<french>\d{{1,4}}(?: bis| ter)?,? (?i:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route|cours) (?i:de la |de l['’]|du |des |de |d['’])?{_WORD})"
    rf"|(?P<roman>(?i:calle|avenida|rua|via|plaza|paseo|camino|carrer|travessa|viale|piazza|largo|praça|ronda) (?i:del |de las |de los |de la |das |dos |da |do |della |delle |dei |di |de )?{_WORD},? (?:n\.?[º°]? ?)?\d{{1,4}}[A-Za-z]?)(?!\w))"
)

#: The span goes on with another capitalised word; one stands just before it; it begins with a title.
_ON = re.compile(rf" (?:{_PARTICLE}){{0,1}}[{_UP}][{_LOW}{_UP}’']|-[{_UP}]|, [{_UP}]\w+ (?:said|saw|hat|a )")
_BEFORE = re.compile(rf"{_WORD}(?: [{_UP}]\.)? $|[{_UP}]\. $|{_WORD} {_PARTICLE}$")
_TITLED = re.compile(r"(?:Mr|Ms|Mrs|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señora?)\b")

# --- context words: general vocabulary of labels, titles, prepositions and verbs, no phrases of any corpus ----------------------------
_PHONE_WORDS = re.compile(r"(?i)phone|call|\btel\b|t[eé]l\.|mobile?\b|cell|\bdesk\b|pager|\bsms\b|\btext\b|\bring\b|\bdial|hotline|\bline:|number|handy|\bfax|reach|tel[eé]fono|t[eé]l[eé]phone|appele|llam|m[oó]vil|notruf|bereitschaft|telefon|rufen|contact|whatsapp|連絡先|電話|电话|联系")
_ID_WORDS = re.compile(r"(?i)\bssn\b|social security|national insurance|passport|tax id|id card|identity|national id|licen[cs]e|personal id|insurance n|steuer|ausweis|reisepass|personnummer|\bdni\b|\bnif\b|\bnino\b|sozialversicherung|sécurité sociale|pasaporte|passeport|身份证|护照|パスポート|マイナンバー")
_NUMBER_TRAPS = re.compile(r"(?i)\border|\bpart\b|\bitem|batch|\bjob\b|build|revision|\brev\b|lines?\b|offset|\bport\b|version|\bid\b|serial|ticket|commit|invoice|\bsku|isbn|rows?\b|code|model|track|slot|position|range|hash|uuid|seek|epoch|took|host|bind")
_HOME_WORDS = re.compile(r"(?i)\blive|address|adresse|direcci|deliver|ship|parcel|post|mail|label|wohn|anschrift|zugestellt|domicil|habite|\bvivo|livr|env[ií]o|entrega|住所|地址|billing|invoice|send|sent|endereço|indirizzo|located|moved|home|office|street|visit|find|map")
_PLACE_TRAPS = re.compile(r"(?i)section|chapter|appendix|part|release|milestone|\bname")
#: What stands just before a name: a label of a role, a word of agency or address, a greeting or sign-off, a title.
_ROLE = re.compile(r"(?i)(?:[\w-]*-by:|\b(?:author|owner|contact|reporter|reviewer|maintainer|assignee|approver|name|user|from|to|cc|lead|editor|writer|autor|contacto|kontakt|responsa?ble|ansprechpartner|encargado|zuständig)\b[\"']? ?[:=|：]?[ \"']*|連絡先[::：]|担当[::：]?|作者[::：]?|負責人[::：]?|[(<\[])\s*$")
_AGENT = re.compile(r"(?i)\b(?:by|to|ask|ping|with|from|via|von|an|bei|durch|mit|laut|frag\w*|bitte|par|selon|avec|voir|demander à|à|a|por|según|con|pregunt\w+ a|para|para|de|was|由|请|請|联系)\s*$")
_GREETING = re.compile(r"(?i)(?:\b(?:dear|hi|hello|hey|hallo|hola|bonjour|thanks|cheers|regards|best|gruß|grüße|grüßen|saludos?|cordialement|vous|sincerely|merci|danke|gracias)\b,?|^--)\s*$")
_TITLE = re.compile(r"(?i)(?:\bmr\.?|\bms\.?|\bmrs\.?|\bdr\.?|\bprof\.?|herrn?|frau|\bm\.|mme\.?|sr\.?|sra\.?|señora?)\s*$")
_ARTICLE = re.compile(r"(?i)(?:\bthe|\ba|\ban|\d|\bsection|\bour|\bnew|\bthis|\beach|der|die|das|le|la|el)\s*$")
_RIGHT = re.compile(r"(?i)^\.?,?\s*(?:<|\(?[\w.+-]+(?:@|%40| ?[(\[]at)|(?:said|says|saw|wrote|writes|asked|told|thinks|noticed|found|reported|reviewed|confirmed|agrees|agreed|mentioned|will|hat|ist|meldet|sagt|a|ha|lo|dit|confirme|dijo|on|for|before|after|during|when|last|yesterday|today|tomorrow|gestern|heute|hier|ce|ayer|hoy|esta|fragen|instead)\b|\|\s*$|and [A-ZÀ-Þ]|さん|氏|様|先生|女士|提交|が)")
_NEGATIVE_RIGHT = re.compile(r"^(?:'s)? (?:keeps|runs|holds|reads|writes|stores|drops|has|is|are|was|were|of the|fails|starts|restarts|stops|uses|listens|loads|crashe[sd]|config\w*|guide|release|cluster|module|service)\b|^ and [A-Z][\w-]+ (?:Court|Drive|Road|Lane|Street)")
#: Nouns of software and of roads, which end no name unless the list of names has them.
_TECH = set(
    "gateway cache queue thread threads pool agent lane drive court road street server service worker scheduler manager handler module node cluster index table buffer stream broker router proxy session token window layer engine library framework api client store build test suite job pipeline request response lock merge page user error code release guide notes version update description summary environment problem steps expected actual behavior behaviour studio cloud actions hub desktop python java script reader writer parser plugin exception interface system data base file files server map plan list view event task model loader driver adapter factory provider listener controller template".split()
)
#: Last parts of names of services, files and hosts inside a network, which no mail address ends with.
_NO_DOMAINS = set("next latest beta canary stable main master head service timer socket target mount slice scope local localdomain internal lan home corp svc cluster json yaml yml toml txt md py js ts java go rs c h sh log cfg conf".split())
#: Words that begin sentences and headings.
_STARTERS = set("the a an could when after before please our with we there see use section error no as is it if for from in on at to and or not none true false der die das bitte seit nach im ohne wir le la il el les los un une al depuis merci can call ask thanks by my i he she they you this that these those what who how why where hello hi dear best kind regards cheers new known internal null read access time step steps main long open dead old last next first windows internet visual apache table getting pull stack hot cold".split())


class Lexicon:
    """The listed names by kind, lower-cased, with the parts of hyphenated ones."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.given = {n.lower() for n, k in rows if n and k == "given"}
        self.family = {n.lower() for n, k in rows if n and k == "family"}


def _line(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands on the same line before and after a span, at most 70 characters each."""
    left, right = text[max(0, a - 70) : a], text[b : b + 70]
    return left[max(left.rfind("\n"), left.rfind("\r")) + 1 :], re.split(r"[\r\n]", right, maxsplit=1)[0]


def _shape(s: str) -> int:
    """A number for the layout of a digit span; 0 if it is no usual one."""
    for k, p in enumerate(_SHAPES, 1):
        if p.fullmatch(s):
            return k
    return 0


_H = "[-‐-–.]"
#: Layouts of identity numbers (first five), then of phone numbers: fixed values.
_SHAPES = [
    re.compile(p)
    for p in (
        r"\d{3}[- ‐-–]\d\d[- ‐-–]\d{4}",
        r"\d\d \d{3} \d{3} \d{3}",
        r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]",
        r"[A-Z]{1,2}\d{7}",
        r"\d{6}-\d{4}",
        r"\+ ?\d{10,14}",
        r"\+ ?\d{1,3}(?:[ .\- ‐-–]?\(?\d{1,5}\)?)+",
        r"00\d{1,3}(?:[ .\-‐-–]\d{1,6})+",
        rf"\(\d{{3}}\) ?\d{{3}}(?:{_H}| )\d{{4}}",
        rf"\d{{3}}{_H}\d{{3}}{_H}\d{{4}}",
        r"0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}",
    )
]


def _box(text: str, end: int) -> int:
    """Where the mailbox that ends before ``end`` begins, however long it is."""
    a = end
    while a and (text[a - 1].isalnum() or text[a - 1] in "_.+-" or text.startswith("%2B", a - 1)):
        a -= 1
    return a


def _emails(text: str) -> Iterator[tuple[str, int, int, list[float]]]:
    for m in _EMAIL.finditer(text):
        a = _box(text, m.start())
        while a < m.start() and text[a] in ".-+":
            a += 1
        if a == m.start():
            continue
        if a and text[a - 1 : a] == "\\":
            continue
        left, right = _line(text, a, m.end())
        at, local, host = m["at"], text[a : m.start()], m["host"]
        disguised = at != "@"
        top = re.split(_DOT, host)
        kind = 0 if at == "@" else 1 if at.strip() in ("%40", "＠", "&#64;", "\\u0040", "\\x40", "\\@") else 2 if at.strip().lower() != "at" else 3 if at == " AT " else 4
        yield (
            "email", a, m.end(),
            [kind, len(top), len(top[-1]), float(top[-1].isalpha()), float(right.startswith((":", "/"))), float(bool(re.fullmatch(r"\d+(?:\.\d+)*", host))),
             float(bool(re.search(r"[/\\`@]$", left))), float(local.lower() in ("git", "hg", "svn", "ssh")), float("." in local or "_" in local or "-" in local or any(c.isdigit() for c in local)), float(disguised), float(bool(re.search(r"\s(?:dot|DOT)\s|[(\[{]", host))), float(local.lower() in _STARTERS), float(top[-1].lower() in _NO_DOMAINS)],
        )


def _numbers(text: str) -> Iterator[tuple[str, int, int, list[float]]]:
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        s = m[0]
        shape = _shape(s)
        if not shape and s[-1].isalpha():
            s = s[:-1].rstrip()
            b = a + len(s)
            shape = _shape(s)
        if not shape and s[0].isalpha():
            cut = len(s) - len(s.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ "))
            s, a = s[cut:], a + cut
            shape = _shape(s)
        left, right = _line(text, a, b)
        digits = sum(c.isdigit() for c in s)
        near = left[-45:]
        feats = [shape, digits, float(s[0] == "+"), float(s[0] == "("), float(bool(_PHONE_WORDS.search(near))), float(bool(_ID_WORDS.search(near))), float(bool(_ID_WORDS.search(right[:40]))), float(bool(_NUMBER_TRAPS.search(left[-18:]))),
                 float(bool(_NUMBER_TRAPS.search(right[:22]))), float(s[0].isalpha()), len(re.findall(r"\d+", s)), float(bool(re.search(r"[:=]\s*['\"]?$", left))), float(not left.strip()), float(not right.strip())]
        yield "phone", a, b, feats
        yield "identity_number", a, b, feats


def _addresses(text: str) -> Iterator[tuple[str, int, int, list[float]]]:
    for m in _ADDRESS.finditer(text):
        a, b = m.span()
        left, right = _line(text, a, b)
        form = ("plain", "german", "french", "roman").index(m.lastgroup) if m.lastgroup else 0
        after = text[b : b + 40]
        yield (
            "street_address", a, b,
            [form, float(bool(_HOME_WORDS.search(left))), float(bool(_PLACE_TRAPS.search(left[-20:] + " "))), float(bool(re.match(r"(?i) (?:of|and|are|is|guide|restarts|keeps)\b", right))), float(bool(re.match(rf",? ?(?:(?i:apt\.?|unit|flat|suite) \d+|\d{{4,5}} {_WORD}|{_WORD})", right))),
             float(not left.strip()), float(not right.strip(" .,"))  , float(bool(re.match(r"(?i)(?:flat|unit|apt|suite|room)", m[0]))), float(bool(re.search(r" [NSEW]\. ", m[0]))), float(bool(re.match(rf"[.,]?\s*(?:(?i:apt\.?|unit) \d+)?\s*{_WORD}", after))), float(bool(re.search(r"(?i)section\s*$", left))), float(m[0].isupper())],
        )


def _names(text: str, lexicon: Lexicon) -> Iterator[tuple[str, int, int, list[float]]]:
    at = 0
    while m := _NAME.search(text, at):
        a, b = m.span()
        if not _TITLED.match(m[0]):  # a title is no part of the name, which is a candidate of its own
            yield _name(text, a, b, m.lastgroup or "full", lexicon)
        at = a + len(m[0].split(" ", 1)[0])  # a title or a sentence's first word may stand before a name


def _name(text: str, a: int, b: int, form: str, lexicon: Lexicon) -> tuple[str, int, int, list[float]]:
    s = text[a:b]
    left, right = _line(text, a, b)
    tokens = [t for t in re.split(r"[ ,]+", s) if t]
    words = [t for t in tokens if not t.endswith(".")]
    given, family = (words[-1], words[0]) if form == "comma" else (words[0], words[-1])
    low = family.lower()
    near = text[max(0, a - 60) : b + 60].lower()
    tech = {w.lower() for w in words} & _TECH - (lexicon.given | lexicon.family)
    street = bool(re.fullmatch(rf"(?i)(?:{_KIND})", family))
    previous = text[:a].rstrip(" \t").rsplit("\n", 2)[-2].strip() if "\n" in text[:a] else ""
    return (
        "person_name", a, b,
        [("full", "comma", "initial").index(form), float(given.lower() in lexicon.given), float(low in lexicon.family), float(given.lower() in lexicon.family or low in lexicon.given), float(bool(_ROLE.search(left))), float(bool(_AGENT.search(left))), float(bool(_GREETING.search(left))), float(bool(_TITLE.search(left))), float(bool(_ARTICLE.search(left))),
         float(bool(_RIGHT.match(right))), float(bool(_NEGATIVE_RIGHT.match(right))), float(not left.strip() and not right.strip(" .,")), len(tech), float(street or low in ("lane", "drive", "court", "road", "street")), float(previous in ("--", "-- ") or previous.lower().startswith(("regards", "best", "thanks", "cheers"))),
         float(low.replace("'", "") in near.replace(s.lower(), "").replace("'", "") and "@" in near), float(any(t.endswith(".") for t in tokens)), float(bool(re.search(_PARTICLE, s[len(first) :])) if (first := tokens[0]) else 0), float(s.isupper()), len(words), float(bool(re.search(r"(?i)(?:and|und|et|y|&)\s*$", left) and re.search(rf"{_WORD}\s+(?i:and|und|et|y|&)\s*$", left))),
         float(bool(re.match(rf"(?i)\s*(?:{_KIND}|str)\b", right))), float(bool(re.match(r"\s*[:=(]", right)) and not re.match(r"\s*\([\w.+-]+(?:@|%40| ?[(\[]| AT)", right)), float(words[0].lower() in _STARTERS),
         float(bool(_ON.match(text, b))), float(bool(_BEFORE.search(left))), float(bool(_TITLED.match(s)) or (s.startswith("M. ") and bool(re.search(r"(?i)(?:à|par|de|chez|monsieur)\s$", left))))],
    )


def candidates(text: str, lexicon: Lexicon) -> list[tuple[str, int, int, list[float]]]:
    """Overlapping candidate spans of a whole text: (type, start, end, features)."""
    return [*_emails(text), *_numbers(text), *_addresses(text), *_names(text, lexicon)]


# --- models -----------------------------------------------------------------------------------------------------------------
#: Rows of labelled candidates that the models are fitted on at most, and the share held out to set thresholds.
FIT_ROWS, HELD_OUT, SEED = 12_000, 0.25, 20_240


@lru_cache(maxsize=2)
def models(lexicon_key: tuple[tuple[str, str], ...]) -> dict[str, Boosted]:
    """One model per type, trained on labelled sentences made by ``trawl.llm.pii_training``."""
    from trawl.llm.pii_training import labelled

    lexicon = Lexicon(list(lexicon_key))
    rows: dict[str, list[tuple[list[float], bool]]] = {t: [] for t in TYPES}
    for text, gold in labelled(SEED, lexicon):
        true = {(t, a) for t, a in gold}
        for t, a, _, x in candidates(text, lexicon):
            rows[t].append((x, (t, a) in true))
    out = {}
    for k, t in enumerate(TYPES):
        some = rows[t][:FIT_ROWS]
        x, y = np.array([r[0] for r in some], float), np.array([r[1] for r in some])
        order = np.random.default_rng(SEED + k).permutation(len(x))
        n = int(len(x) * (1 - HELD_OUT))
        out[t] = Boosted().fit(x[order[:n]], y[order[:n]]).calibrate(x[order[n:]], y[order[n:]])
    return out


def find(texts: list[str], lexicon: Lexicon, trained: dict[str, Boosted]) -> list[list[tuple[str, int, int, float]]]:
    """For each text the items taken: (type, start, end, probability), in order, without overlaps."""
    proposed = [candidates(t, lexicon) for t in texts]
    chance: dict[str, np.ndarray] = {}
    for t in TYPES:
        x = [c[3] for cs in proposed for c in cs if c[0] == t]
        chance[t] = trained[t].probability(np.array(x)) if x else np.empty(0)
    at = dict.fromkeys(TYPES, 0)
    out = []
    for cs in proposed:
        sure = []
        for t, a, b, _ in cs:
            p = chance[t][at[t]]
            at[t] += 1
            if p >= trained[t].cut:
                sure.append((p, t, a, b))
        taken: list[tuple[str, int, int, float]] = []
        used: list[tuple[int, int]] = []
        for p, t, a, b in sorted(sure, key=lambda r: (r[1] != "email", -r[0], r[2] - r[3], r[2])):  # a name inside an email is no item
            if all(b <= c or a >= d for c, d in used):
                taken.append((t, a, b, float(p)))
                used.append((a, b))
        out.append(sorted(taken, key=lambda r: r[1]))
    return out


def redact(text: str, items: list[tuple[str, int, int, float]]) -> str:
    """The text with every item replaced by its type in brackets, the rest unchanged."""
    out, at = [], 0
    for t, a, b, _ in items:
        out += [text[at:a], f"[{t.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_ITEM = "array<struct<pii_type:string,start_pos:int,end_pos:int,probability:double>>"


def detect(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, items, redacted) per row of ``documents``.

    Positions count code points from 0. A null text gives no items and a null redacted text, an empty one no items and itself; texts are read
    whole; repeated rows give repeated rows. ``lexicon`` (name_text, name_kind) is a small table (more than 20,000 rows are an error) and may be empty; other columns are not read.
    """
    rows = sorted({(r[0], (r[1] or "").strip().lower()) for r in settings(lexicon.select("name_text", "name_kind").filter("name_text IS NOT NULL"), 20_000)})
    sent = documents.sparkSession.sparkContext.broadcast((rows, models(tuple(rows))))

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, trained = sent.value
        lex = Lexicon(names)
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["text"]]
            found = find([t or "" for t in texts], lex, trained)
            items = [[{"pii_type": t, "start_pos": a, "end_pos": b, "probability": p} for t, a, b, p in x] for x in found]
            yield pd.DataFrame({"doc_id": f["doc_id"], "items": items, "redacted": [None if t is None else redact(t, x) for t, x in zip(texts, found, strict=True)]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(apply, f"doc_id {kind}, items {_ITEM}, redacted string")


def located(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos): one row per item."""
    return detect(documents, lexicon).select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.pii_type", "x.start_pos", "x.end_pos")

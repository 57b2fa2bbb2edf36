"""Template residue, filler, error pages and demands for scripts in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.bpe import blocks
from tickforge.sources.shared import write_shared

#: Documents in which a message must recur for a weak rule to count; their sources must be several.
RECURS_DOCS = 3
#: Characters of a message at most. Longer sentences aren't grouped; fields and messages within them are found by the sure rules.
MESSAGE_CHARS = 240

# The rules' words and patterns.
#: Strings without which a unit can't be a template field, a message or a demand (lower case, one space for any). Every
#: alternative of FIELDS, MESSAGES and CHROME holds one; "\n" stands for the begin of a unit.
TRIGGERS_WITH_SPACES = (
    "active content", "not found", "no longer", "could not be", "cannot be", "moved or withdrawn", "search form", "sign in again", "too many requests",
    "slowed down", "database connection", "did not answer", "not allowed from", "went wrong", "request id", "ocr job", "text layer", "loading viewer",
    "help desk", "nicht gefunden", "nicht verfügbar", "versuchen sie", "no se encuentra", "no disponible", "vuelva a", "at com.", "at java.", "at org.",
    "full-text viewer", "| search |", "goes here", "your own wording", "how the text will look", "final wording", "sample text", "dummy text", "test text", "example text", "upstream timed out",
    "filler text", "placeholder text", "lorem ipsum", "texte de remplissage", "faux texte", "texto de relleno", "not a robot", "heading ", "not work without",
    "switch them on", "bad gateway", "gateway timeout", "bad request", "access to this", "try again", "quote reference", "melden sie sich", "_ _", " | ",
    "\nat ", "\n at ", ". at ", "! at ", "? at ", "。at ", "！at ", "？at ", "。 at ", "！ at ", "？ at ",
)
TRIGGERS_WITHOUT = (
    "{", "$", "%", "#", "__", "@@", "<<", "«", "[[", "[ins", "[hier", "[tk", "[to be", "[your", "<insert", "【", "［", "javascript", "noscript", "scripting",
    "cookies", "error", "fehler", "erreur", "エラー", "错误", "exception", "forbidden", "session", "sesión", "sitzung", "会话", "セッション", "robot",
    "unavailable", "incident", "anmelden", "introuvable", "expiré", "indisponible", "reconnecter", "caducado", "見つかりません", "不存在", "已过期", "不可用",
    "利用できません", "bullet", "blindtext", "ダミーテキスト", "示例文本", "占位", "xxxxx", "_____", ".....", "n/a", "js", "activez", "unauthori", "<fault>", "réessayez", "subheading",
)
#: Triggers only where a word begins, as they are part of common words (description).
TRIGGERS_OF_WORDS = ("script",)
#: Template fields; a field's name is anything short without the bracket.
FIELDS = (
    r"\$\{[^{}\n]+\}", r"(?<![\\a-z}])\{\{[^{}\n]+\}\}", r"<%[^%\n]+%>", r"\{%[^%\n]+%\}", r"%\([^()\s]+\)s", r"%[^\W\d][\w.#]{2,}%",
    r"__[^\W\d_][\w#]+?__", r"@@[\w#]{2,}@@", r"<<[\w #]{2,}>>", r"«[^\W\d][\w#]{2,}â?»", r"\$[^\W\d][\w#]{2,}\$", r"(?<!#)#[^\W\d][\w#]{2,}#(?!#)", r"\[\[[^\[\]\n]{2,}\]\]",
    r"\[(?:insert\w*|hier|insér\w*|insir\w*)\b[^\[\]\n]{2,}\]", r"\[tk\b[^\[\]\n]*\]", r"\[to be (?:completed|added|inserted|filled)[^\[\]\n]*\]",
    r"\[your\b[^\[\]\n]{2,}\]", r"<insert\b[^<>\n]{2,}>", r"\{[\w. #]{2,}:\s?undefined\}", r"(?<![\[;,] )(?<![\w^_}\\{\[;,])\{#\}(?![\w,;{}\]])",
)
#: Messages of failed pages, demands for scripts and filler, in units of lower case with numbers as #.
MESSAGES = (
    r"\b(?:enable|activate|turn on|switch on|allow)\b.{0,20}\b(?:javascript|js|scripts?|scripting|cookies)\b",
    r"\b(?:javascript|scripts?|scripting|script support|active content|cookies)\b.{0,30}\b(?:is|are|must|needs?|ha[sv]e to)\b.{0,20}\b(?:off|disabled|blocked|enabled|allowed|permitted|activated|required|turned on)\b",
    r"<noscript>", r"\bonly with (?:java)?script", r"\bblocking scripts\b", r"\bnot work without (?:java)?scripts?\b", r"\bswitch them on and reload\b", r"\bactive content is permitted\b",
    r"\bschalten sie javascript\b", r"\bjavascript\b.{0,40}\b(?:aktivieren|einschalten|ein\b)", r"\bexige javascript\b", r"\bactivez\b.{0,30}\b(?:page|javascript)\b", r"\bactivar javascript\b",
    r"javascriptを有効", r"启用javascript", r"^# (?:error|forbidden|not found|bad gateway|internal server error|service unavailable|gateway timeout|bad request|unauthori[sz]ed)$",
    r"\b(?:page|document|publication|address|file)\b.{0,40}\b(?:not found|could not be (?:found|served|shown|loaded|displayed)|no longer (?:here|available)|cannot be (?:shown|displayed|found|loaded))\b",
    r"\bmoved or withdrawn\b", r"\bback to the search form\b", r"\bsession has (?:ended|expired|timed out)\b", r"\bsign in again\b", r"^too many requests\b", r"\byour address was slowed down\b",
    r"\bdatabase connection failed\b", r"\bservice did not answer\b", r"\baccess to this \w+ is (?:not allowed|denied|forbidden)\b", r"\bsomething went wrong\b", r"\byou are not a robot\b", r"^request id #",
    r"\bocr job\b", r"\btext layer missing\b", r"\bloading viewer\b", r"\b(?:temporarily|momentarily) unavailable\b", r"\btry again (?:later|in #)", r"\bquote reference\b", r"\bhelp desk\b", r"^incident #",
    r"^(?:\S+\.)?\w+(?:exception|error): ", r"^at [\w.$]+\([\w.]+:#\)", r"<fault>", r"^\{\"status\": ?#,.*\"error\":", r"\bupstream timed out\b", r"\bseite wurde nicht gefunden\b", r"\bsitzung ist abgelaufen\b", r"\bmelden sie sich erneut an\b", r"\bvorübergehend nicht verfügbar\b",
    r"\bversuchen sie es\b", r"\best introuvable\b", r"\bsession a expiré\b", r"\bvous reconnecter\b", r"\bmomentanément indisponible\b", r"\bréessayez\b", r"\bno se encuentra la página\b", r"\bsesión ha caducado\b",
    r"\bvuelva a iniciar", r"\bno disponible\b.{0,30}\b(?:servicio|más tarde)|\bservicio\b.{0,30}\bno disponible\b", r"ページは見つかりません", r"セッションの(?:有効期限|期限)", r"(?:現在|一時的に).{0,8}利用できません", r"(?:页面|网页)不存在", r"会话已(?:过期|超时)", r"(?:服务|页面).{0,6}不可用",
    r"\bbody copy goes here\b", r"\bby your own wording\b", r"\bhow the text will look\b", r"\bput the final wording later\b", r"\bblindtext\b", r"\blorem ipsum\b", r"(?:\b(?:sample|dummy|test|example|filler|placeholder) text[ .]*){3,}", r"^(?:sample|dummy|test|example|filler|placeholder) text\.?$",
    r"\b(?:texte de remplissage|faux texte|texto de relleno)\b", r"ダミーテキスト|示例文本|占位(?:符|文)", r"^subheading$", r"^heading #$", r"^- bullet (?:one|two|three|#)$",
    r"(?<!\w)x{5,}(?!\w)", r"^[_ ]{6,}$", r"^[. ]{6,}$", r"^(?:n/a[ ]?){3,}$",
)
#: Parts of a page around a message: residue only where they recur across sources.
CHROME = (r"^full-text viewer$", r"^(?:\w+ \| ){2,}\w+$")
#: Parts of a document that a field may stand for.
SLOTS = (
    "title", "titel", "titre", "título", "abstract", "zusammenfassung", "abrégé", "resumen", "description", "beschreibung", "descripción", "claims?", "ansprüche", "revendications", "reivindicaciones", "summary", "background",
    "drawings?", "figures?", "applicant", "anmelder", "demandeur", "solicitante", "inventors?", "erfinder", "inventeur", "assignee", "author", "name", "date", "datum", "number", "body", "content", "heading", "text", "field", "ipc",
)
#: A message speaks to its reader, or tells the reader to do something ...
ADDRESS = (
    r"\b(?:you|your|please|sorry|we are|our (?:side|team|end|site))\b", r"^(?:re-?load|refresh|click|tap|sign (?:in|up)|log ?(?:in|on)|contact|try|wait|go back|return to|come back|visit|register|subscribe|replace|put|fill in|type|enter|update|upgrade|install|write|edit|delete)\b",
    r"\b(?:bitte|ihre[mnrs]?|veuillez|votre|vos|por favor|inténtelo|vuelva)\b", r"(?:して|て)ください", r"[请您]",
)
#: ... and it is about pages, their delivery, or text still to be written.
PAGE = (
    r"\b(?:pages?|(?:web)?sites?|browsers?|servers?|sessions?|log-?in|sign in|viewers?|network|passwords?|accounts?|links?|windows?|tabs?|cookies?|scripts?|javascript|documents?|publications?|full text|pdf|downloads?|help ?desk|support|administrators?|service|connection|proxy|requests?)\b",
    r"\b(?:template|placeholder|paragraph|passage|wording|sample|dummy|draft|editor|final text)\b", r"\b(?:seiten?|dokument|sitzung|browser|anmeld\w+|navigateur|document|connexion|página|documento|sesión|navegador|servicio)\b", r"ページ|文書|ブラウザ|页面|网页|浏览器|文档|会话",
)
#: Words before a field or a message that is only spoken of.
MENTION = re.compile(r"(?:\b(?:such (?:\w+ )?as|string|text|words?|markers?|notice|message|reading|symbol|token|label)\s*(?:&quot;|[\"'“„`])?|(?:&quot;|[\"“„])[^\"”]{0,40})$")
#: Sentences about messages, not messages.
ABOUT = re.compile(r"\b(?:shown|depicted|displayed|produced) by\b|\bshows (?:\w+ ){0,2}(?:words|error page|message)\b|\btells (?:\w+ ){0,3}user\b|\bstate of (?:\w+ ){1,2}art\b|\b(?:is|becomes) put into\b|\b(?:the|tbe) invention\b|\bclaims? #")
#: The commonest words of the corpus' languages; running text has some, filler and struck keys have none.
COMMON = frozenset(
    "the of and to in is a an for with by from that which on or as be are it its this at not was has have been may can via per than when but into no between one two "
    "der die das und in den von zu mit ist ein eine einer eines dem des im für auf wird nach bei aus oder über unter nicht sich als an durch bis "
    "le la les de des du un une et en est dans par pour sur que qui avec au aux selon ou ne pas plus l' d' "
    "el los las del y es por con para una se al según su lo como entre o más".split()
)
LATINATE = re.compile(r"^[a-z]+(?:um|us|at|es|is|it|a|o|i|or|in|et|ub|al|en|e|ue|ibor)$")
HOME_ROW = re.compile(r"^[asdfghjkl]+$")

_FIELD = re.compile("|".join(FIELDS))
_MESSAGE = re.compile("|".join(MESSAGES))
_CHROME = re.compile("|".join(CHROME))
_ADDRESS, _PAGE = re.compile("|".join(ADDRESS)), re.compile("|".join(PAGE))
_MARK = r"[^\w\s.,;:'\"()/+=*-]{1,3}"
#: A part's name, or two words with one, between marks of any kind; what the marks are is told by group 1 and 2.
_SLOT = re.compile(rf"({_MARK}) ?(?:\w+[._ :])?(?:{'|'.join(SLOTS)})(?:[._ ]\w+)? ?({_MARK})(?!\w)")
_NUMBER = re.compile(r"\d(?<![^\W\d_]\d)\d*(?:[.,:/-]\d+)*(?![^\W\d_])")
_ENDS = ((". ", ".\n"), ("! ", "!\n"), ("? ", "?\n"), ("。", "。\n"), ("！", "！\n"), ("？", "？\n"))
_SPACE = re.compile(r"[^\S\n ]|  ")
_SPACES = re.compile(r"[^\S\n]+")
#: Begin of the units that stand for a kind of field.
SLOT = "field of marks "
_HIDDEN = ("​", "‌", "‍", "­", "﻿")
_MASKS = (
    (re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+"), "#"),
    (re.compile(r"\b\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b"), "#"),
    (re.compile(r"\b(?=[0-9a-f-]*\d)[0-9a-f]{2,}-[0-9a-f-]{2,}\b"), "#"),
    (re.compile(r"(?<![^\W\d_])\d+(?:[.,:]\d+)*(?![^\W\d_])"), "#"),
)


_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]+")


def _reread(found: re.Match) -> str:
    try:
        return found.group().encode("latin-1").decode()
    except UnicodeDecodeError:
        return found.group()


def normalise(unit: str) -> str:
    """Addresses, dates, ids and numbers as #, one space for any, and digits within words as the letters they resemble."""
    for pattern, to in _MASKS:
        unit = pattern.sub(to, unit)
    if any(c in unit for c in "01"):
        unit = re.sub(r"(?<=[^\W\d_])1|1(?=[^\W\d_])", "l", re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "o", unit))
    return " ".join(unit.split())


def is_filler(unit: str) -> bool:
    """Words without one common word of any language: struck keys, or sentences of Latin look."""
    words = re.findall(r"[^\W\d_]+", unit)
    if len(words) < 5 or not COMMON.isdisjoint(words):
        return False
    if sum(bool(HOME_ROW.match(w)) for w in words) >= 0.85 * len(words):
        return True
    return len(words) >= 8 and all(map(str.isascii, words)) and sum(bool(LATINATE.match(w)) for w in words) >= 0.9 * len(words) and len(set(words)) < len(words)


def spoken_of(unit: str, at: int) -> bool:
    """Whether what begins at ``at`` is quoted or named as an example, not used."""
    before = unit[:at]
    return bool(MENTION.search(before) or re.search(r"\bsuch as \S.{0,80} or $", before))


def rule(unit: str) -> int:
    """2: residue by itself; 1: residue where it recurs across sources; 0: none. ``unit`` is normalised."""
    if any(not spoken_of(unit, m.start()) for m in _FIELD.finditer(unit)):
        return 2
    if not ABOUT.search(unit) and any(not MENTION.search(unit[: m.start()]) for m in _MESSAGE.finditer(unit)):
        return 2
    return 2 if is_filler(unit) else weak_rule(unit)


def weak_rule(unit: str) -> int:
    """1: residue where it recurs across sources (a kind of field, a page's frame, a notice to the reader); 0: none."""
    return int(unit.startswith(SLOT) or bool(_CHROME.search(unit)) or is_notice(unit))


def is_notice(unit: str) -> bool:
    """A sentence to the reader of a page, as no patent has one."""
    if ABOUT.search(unit) or not _PAGE.search(unit):
        return False
    return any(not MENTION.search(unit[: m.start()]) for m in _ADDRESS.finditer(unit))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in (*TRIGGERS_WITHOUT, *TRIGGERS_WITH_SPACES):
        found.add_word(word.replace("1", "l").replace("0", "o"), 0)
    for word in TRIGGERS_OF_WORDS:
        found.add_word(word, len(word))
    found.make_automaton()
    return found


def _hits(triggers: ahocorasick.Automaton, folded: str) -> Iterator[int]:
    """Where triggers end in a text that begins with a line break."""
    for at, word in triggers.iter(folded):
        if not (word and ((c := folded[at - word]).isalnum() or c == "_")):
            yield at


def plain(text: str) -> str:
    """Lower case, without hidden characters, single spaces, and UTF-8 that was once read as Latin-1 read again."""
    if not text.isascii():
        text = _MISREAD.sub(_reread, text)
    low = text.lower()
    for c in _HIDDEN:
        if c in low:
            low = low.replace(c, "")
    low = low.replace("\xa0", " ").replace("\r", "\n")
    return _SPACES.sub(" ", low) if _SPACE.search(low) else low


def sentences(text: str) -> str:
    """A line break after each sentence."""
    for end, cut in _ENDS:
        text = text.replace(end, cut)
    return text


def units(text: str, triggers: ahocorasick.Automaton) -> dict[str, bool]:
    """Normalised units (lines, and sentences of a line) of a whole text; True for those the sure rules may hold for.

    A named part between marks of any kind yields a unit of its own without the name, so that a kind of field recurs
    whatever it stands for.
    """
    low = "\n" + plain(text)
    folded = low.replace("1", "l").replace("0", "o") if "0" in low or "1" in low else low
    sure: set[str] = set()
    hit: set[int] = set()
    end = -1
    for at in _hits(triggers, folded):
        if at < end:
            continue
        start = low.rfind("\n", 0, at) + 1
        end = low.find("\n", at)
        end = len(low) if end < 0 else end
        hit.add(start)
        for s in sentences(low[start:end]).split("\n"):
            if any(True for _ in _hits(triggers, "\n" + s.replace("1", "l").replace("0", "o"))):
                sure.add(normalise(s))
    start = 0
    for line in low.split("\n"):
        if COMMON.isdisjoint(words := line.split()) and len(words) >= 5:
            unit = normalise(line)
            if start not in hit or is_filler(unit):
                sure.add(unit)
        start += len(line) + 1
    out = dict.fromkeys((u for s in sentences(_NUMBER.sub("#", low)).split("\n") if (u := s.strip()) and len(u) <= MESSAGE_CHARS), False)
    for m in _SLOT.finditer(low):
        if not low[m.start() - 1].isalnum() and not spoken_of(low[low.rfind("\n", 0, m.start()) + 1 : m.start()], m.start()):
            out[f"{SLOT}{m[1]} {m[2]}"] = False
    out.update((u, True) for u in sure if u)
    return out


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(``key``): documents with residue anywhere in the text, one row per distinct key.

    Whole texts are cut into sentences. Numbers, addresses and dates are masked, and all units are grouped by the hash of
    what is left, across documents and sources. Each distinct message that recurs in ``RECURS_DOCS`` documents of several
    sources is then classified once by placeholder and phrase rules: a kind of field (marks around the name of a part),
    the frame of a page, or a notice to the reader about pages, browsers, sessions, drafts. What is unmistakable by itself
    (a known field syntax, a known message of a failed page, filler) counts at any frequency, as a small corpus has each
    message but once. A field or message that a sentence only speaks of (quoted, named as an example) is none, nor are
    marks for lost formulas.

    Null, empty and blank texts are no cases; null keys come out as a null key; a null source counts as one source.
    Grouping is combined on the map side, so a message in a third of all documents costs one row per map task. Hashes
    have 64 bits.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = _automaton()
        for batch in batches:
            for rows, texts in blocks(batch, text):
                at, found, sure = [], [], []
                for i, t in enumerate(texts):
                    if t:
                        of = units(t, triggers)
                        at.extend([i] * len(of))
                        found.extend(of)
                        sure.extend(of.values())
                if at:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(found), pa.array(sure)], names=["key", "source", "unit", "sure"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(rule(unit) if sure else weak_rule(unit)) + recurs > 1 for unit, sure, recurs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["hash"])

    read = docs.select(F.col(key), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text))
    found = read.select(key, "source", text).mapInArrow(search, f"key {kind}, source string, unit string, sure boolean").withColumn("hash", F.xxhash64("unit"))
    stored = docs.sparkSession.read.parquet(write_shared(found, "units"))
    recurs = (F.count(F.lit(1)) >= RECURS_DOCS) & (F.min("source") != F.max("source"))
    groups = stored.groupBy("hash").agg(F.any_value("unit").alias("unit"), F.max("sure").alias("sure"), recurs.alias("recurs")).where("sure or recurs")
    messages = groups.mapInArrow(classify, "hash bigint")
    return stored.join(messages, "hash", "left_semi").select(F.col("key").alias(key)).distinct()

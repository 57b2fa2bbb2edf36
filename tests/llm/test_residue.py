import itertools
import re
from re import _constants as C
from re import _parser

import pytest

from tickforge.llm import residue
from tickforge.llm.residue import _automaton, find_residue, normalise, rule, units, weak_rule

A = _automaton()


def strength(text):
    return max((rule(u) if sure else weak_rule(u) for u, sure in units(text, A).items()), default=0)


RESIDUE = [
    "A valve.\nABSTRACT\n[INSERT ABSTRACT HERE]", "Patent {{ doc.title }}", "The ${record.claims!} relates to a pump.", "x __BACKGROUND__ y", "<%= patent.summary %>", "%(claim_1)s", "@@CLAIM_1@@", "<<INVENTOR_LIST>>", "«inventor_list»",
    "[[field:title]]", "{claims:undefined}", "{% block title %}", "{{#if title}}{{/if}}", "$ABSTRACT$", "#summary#", "Patent {0}", "[HIER TITEL EINFÜGEN]", "[INSÉRER TITRE ICI]", "[INSERTAR TÍTULO AQUÍ]", "[TK: title]", "[to be completed: claims]", "[Your claims goes here]", "<insert title>",
    "A pump.\nPlease enable JavaScript to read this page.", "Enable JS to continue.", "Enab1e JS t0 c0ntinue.", "Error 404: no se encuentra la pÃ¡gina solicitada.", "Service momentanÃ©ment indisponible", "En​able JS to continue.", "このページを表示するにはJavaScriptを有効にしてください。", "请启用JavaScript后再查看此页。", "Bitte schalten Sie JavaScript in Ihrem Browser ein.",
    "404 Error\nThe address you asked for could not be served by this host.", "java.lang.IllegalStateException: renderer closed\n\tat com.example.Job.run(Job.java:74)", "Too many requests. Wait 5 seconds.", "Your session has ended for safety.", '{"status": 502, "error": "upstream timed out"}',
    "Lorem ipsum dolor sit amet", "Sample text Sample text Sample text", "sdfg hjkl asdf ghjk lkjh gfds", "Velum quares nunque errub velum solit minaret. Obtis lumen quares solit magnis ferat.", "xxxxxxxxxx", "______________", "................", "n/a n/an/a n/a",
]
CLEAN = [
    'A marker such as ${summary} or %SUMMARY% is looked up in the script engine; markers without an entry are reported by the timer.', "The string [INSERT USER HERE] is an example of an instruction which the timer passes to the cache.",
    'In a known system the text "{{user}}" remains visible when the log sink receives no value.', 'The notice "please enable JavaScript" is shown by the cache only as long as the probe has not set its flag.', 'FIG. 3 shows an error page reading "access denied" as it is produced by the cache according to the state of the art.',
    "The timer tells the user that cookies have to be allowed, whereas the cache of the invention asks for nothing.", 'If the server answers with status 404 or 503, the cache shows the words "page not found" or "service unavailable" to the operator.',
    "Filler text, for example a meaningless pseudo-Latin passage, is put into the cache for a preview and is removed by the timer before printing.", r"\frac{{a_1}}{{b}} + \sum_{i=1}^{3} x_i", "[3.24; {0, 1}]", "[Formula 3]", "[Chemical formula 2: not reproduced]", "<math><mi>k</mi><mo>=</mo></math>",
    "##STR00027##", "as in ##STR1## above", "TBD (1,5,7-triazabicyclodecene) / DMF = 3:1", "- 8 -", "[0001] The valve seat is omitted.", "η = ???", "A device for detecting the script capability of a browser", "Robot gripper with compliant fingers and use thereof", "ZUSAMMENFASSUNG", "R¹–R⁴ = H, ��", "<|endoftext|>", "The rate is 5 % to 10 % of # 3.", "costs $5 to $9",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert strength(text) == 2


@pytest.mark.parametrize("text", CLEAN)
def test_no_residue(text):
    assert strength(text) == 0


def test_documents(spark, rows):
    long = "The valve seat is coupled to the spring cage. " * 30_000
    data = [(1, "A pump.\n[INSERT TITLE HERE]", "a", "u"), (2, "A pump.", "a", "u"), (3, None, "a", "u"), (4, "", None, "u"), (5, "  \n ", "a", "u"), (6, long + "Enable JS to continue.", None, "u"), (7, long, "a", "u"), (1, "A pump.\n[INSERT TITLE HERE]", "a", "u"), (None, "{{title}}", "a", "u")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, unit string")
    assert rows(find_residue(df)) == [(None,), (1,), (6,)]
    assert rows(find_residue(df.limit(0))) == []


def test_frames_of_pages_count_where_they_recur(spark, rows):
    data = [(i, "Full-text viewer\nA pump.", "ab"[i % 2]) for i in range(4)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    assert len(rows(find_residue(df))) == 4
    assert rows(find_residue(df.where("source = 'a'"))) == []


def examples(pattern):
    """Strings of every alternative of a parsed pattern; anchors and looks around are left out."""
    parts = []
    for op, v in pattern:
        if op is C.LITERAL:
            parts.append([chr(v)])
        elif op is C.IN and v[0][0] is not C.NEGATE and all(o is C.LITERAL for o, _ in v):
            parts.append([chr(c) for _, c in v])
        elif op is C.BRANCH:
            parts.append([s for b in v[1] for s in examples(b)])
        elif op is C.SUBPATTERN:
            parts.append(examples(v[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, what = v
            times = sorted({least, min(most, least + 1), min(most, least + 3)})
            free = what[0][0] is C.ANY or (what[0][0] is C.IN and what[0][1][0][0] is C.NEGATE)
            parts.append([(" a" * k)[:k] for k in times if k] + ["a", "aaa", " ", " a "] if free and most > 2 else [o * k for k in times for o in examples(what)])
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
            parts.append(["a"])
    return {"".join(x) for x in itertools.product(*parts)}


@pytest.mark.parametrize("pattern", [*residue.FIELDS, *residue.MESSAGES, *residue.CHROME])
def test_every_alternative_of_the_rules_is_reached(pattern):
    texts = {t for x in examples(_parser.parse(pattern)) for t in (x, f"{x} b", f"A {x}", x.replace(" ", " \t")) for t in (t, t.replace("#", "5"))}
    cases = {t for t in texts if re.search(pattern, normalise(t.lower())) and not re.search(r"[.!?]\s", t)}
    assert cases
    assert {t for t in cases if not units(f"A valve is shown.\n{t}", A).get(normalise(t.lower()))} == set()


@pytest.mark.parametrize(
    "text",
    ["502 Bad Gateway", "504 Gateway Timeout", "400 Bad Request", "401 Unauthorized", "Please try again later.", "Access to this document is denied", "Please enable scripts", "Scripts are disabled in your browser", "Enable JS.",
     "Réessayez plus tard", "Subheading", "[INSIRA TÍTULO AQUI]", "_ _ _ _ _ _", "Page  not\u2003found", "Wait. Try again later", "at Foo.bar(Foo.kt:12)", "Velum quares nunque errub velum solit minaret scripta."],
)
def test_residue_without_other_triggers(text):
    assert strength(text) == strength(f"The pump is shown.\n{text}") == 2


def test_any_two_sources_are_two(spark):
    names = [f"s{i}" for i in range(64)]  # some two of them have one hash modulo 63
    hashed = spark.createDataFrame([(n,) for n in names], "s string").selectExpr("s", "pmod(xxhash64(s), 63) h").groupBy("h").agg({"s": "collect_list"}).collect()
    one, other = next(x[1][:2] for x in hashed if len(x[1]) > 1)
    data = [(i, "Full-text viewer\nA pump.", (one, other)[i % 2]) for i in range(4)]
    assert len(find_residue(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()) == 4


@pytest.mark.parametrize(
    "text",
    ["Please refresh this window of your browser.", "Sign up for an account to go on reading.", "You have read 3 of 5 free documents.", "Contact the administrator of this site (ref. 88).", "Return to the list of publications.", "Type the draft of this paragraph.",
     "Bitte laden Sie die Seite neu.", "Veuillez recharger la page.", "[~claims~]", "~~TITLE~~", "the {|abstract|} of a pump", "[@inventor name@] valve"],
)
def test_wording_of_no_list_counts_where_it_recurs(spark, rows, text):
    assert strength(text) == 1
    data = [(i, f"A pump.\n{text}\nThe valve no. {i} is shut.", "ab"[i % 2]) for i in range(4)] + [(9, "A pump.\nThe valve no. 9 is shut.", "a")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    assert rows(find_residue(df)) == [(i,) for i in range(4)]
    assert rows(find_residue(df.where("doc_id in (0, 9)"))) == []


@pytest.mark.parametrize(
    "text",
    ["The server of claim 3 tells you its session.", "The notice \"please refresh the page\" is shown by the cache.", "A pump with two valves is shown.", "Such fields as {|title|} are known.", "ABSTRACT", "Press for sheets", "##STR00027##", "<math>", "Description", "[0001] The pump is shown."],
)
def test_sentences_of_patents_may_recur(spark, text):
    data = [(i, f"A pump.\n{text}", "ab"[i % 2]) for i in range(6)]
    assert find_residue(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect() == []

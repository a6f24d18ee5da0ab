import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewell.llm import residue

RESIDUE = [
    ("<html><body><h1>502 Bad Gateway</h1><hr>webd/2</body></html>", "text/html"), ('{"ok": false, "errors": [{"detail": "Lehte ei leitud"}]}', "application/json"), ("Please enable JavaScript to continue", None), ("Ошибка 403: доступ запрещён", "text/plain"),
    ("<p>Lorem dolor sit amet consectetur.</p>", None), ("TBD TBD TBD", None), ("<div><noscript>You need to enable JavaScript to run this app.</noscript></div><script src=a.js></script>", "text/html"),
    ('{"message": "Your parcel is here.", "title": "Hello {{ name }}, welcome."}', "application/json"), ("<p>Hello &lt;first_name&gt;, thanks for your order today.</p>", "text/html"), ("Dear [INSERT name], your box is open.", None), ('cb({"a": "%%user%% is back."});', "application/javascript"),
    ("<title>Hello {{name}}</title><p>Your order was sent on Monday.</p>", "text/html"), ("<p>Hello &#123;&#123;name&#125;&#125;, your order was sent.</p>", "text/html"), ('{"success": 0, "html": "<p>Oops! Something went wrong.</p>"}', "application/json"), ("<p>Total due: <<amount>> for you.</p>", "text/html"), ("Use *|CODE|* or @@code@@ or #{code} now.", None),
    ("Hello {{" + "name | " * 60 + "x}}, welcome.", None), (" " * 300 + "<p>Page not found</p>", None),
]
CONTENT = [
    ("", None), ("   ", None), ("ok", None), ("pong", "text/plain"), ('{"ok":true}', "application/json"), ('{"items":[],"error":null}', "application/json"), ("[]", None), ("GIF89a", None), ("null", None),
    ("Guide: if a page shows “Page not found”, check the link and ask again.", None), ("Latin lesson 3: the word dolor means pain.", None), ("In mail merges a field such as {{first_name}} is swapped for a name.", None),
    ("<script>var t='{{title}}';f(`${x.id}`)</script><p>Your order was sent on Monday.</p>", "text/html"), ("var tpl='<li>{{label}}</li>';", "application/javascript"), ("<noscript>Please enable JavaScript.</noscript><p>Your order was sent today.</p>", "text/html"),
    ("Set {a, b, c} has 3 members; price list [EUR] below, see <b>.", None), ("<h1>404 Not Found</h1><p>But your order was sent on Monday, and it will come.</p>", "text/html"), ("Service was unavailable for 5 minutes; since then all is fine.", None),
]
#: Not taken from the data, nor from the lists that the judge learns from (whose words they share).
UNSEEN = """We couldn't find that page.|Die angeforderte Seite existiert nicht.|La pagina richiesta non esiste.|Please turn JavaScript on and reload the page.|Database connection failed|The document you wanted is gone.|This website needs scripts.|Sorry, this page isn't available.|The page has been deleted or never existed.|Our server is having trouble right now, please try again later.|Access to this resource is denied.|You do not have permission to open this file.|Connection to the server was lost.|This service is temporarily unavailable, please come back later.|Error 503: the server cannot handle the request.|Your session has timed out.|Your browser has JavaScript disabled.|Placeholder text goes here|Sample paragraph, replace with your own text|Insert your content here
Leider wurde die Seite nicht gefunden.|Der Zugriff auf diese Seite wurde verweigert.|Bitte JavaScript im Browser einschalten.|Es ist ein unerwarteter Fehler aufgetreten.|Désolé, cette page est introuvable.|Accès à cette page refusé|Une erreur inattendue est survenue.|JavaScript doit être activé pour voir cette page.|Lo sentimos, no encontramos la página.|Se produjo un error inesperado, inténtelo más tarde.|Debe habilitar JavaScript en su navegador.|Accesso a questa pagina negato|Si è verificato un errore del server.|Desculpe, a página não foi encontrada.|Ocorreu um erro inesperado, tente mais tarde.|De pagina kon niet worden gevonden.|Er is een onverwachte fout opgetreden.|Sidan kunde tyvärr inte hittas.|Ett oväntat fel inträffade.|Valitettavasti sivua ei löytynyt.|Selaimen JavaScript on pois päältä.|Kahjuks lehte ei leitud.|Tekkis ootamatu viga, proovige hiljem uuesti.|Niestety strony nie znaleziono.|Wystąpił nieoczekiwany błąd serwera.|Proszę włączyć JavaScript w przeglądarce.|К сожалению, страница не найдена.|Произошла непредвиденная ошибка, попробуйте позже.|Включите JavaScript в браузере.|お探しのページは見つかりませんでした。|予期しないエラーが発生しました。|抱歉，您访问的页面不存在。|服务器发生错误，请稍后再试。""".replace("\n", "|").split("|")


def found(body, mime):
    weights = residue.judge_weights()
    if residue.has_slot(body, mime):
        return True
    shown = [residue.verdict(t, 0.5, weights) for t in residue.templates_of(residue.sentences(body, mime))]
    behind = [residue.verdict(t, 0.5, weights) for t in residue.templates_of(residue.hidden_sentences(body))]
    return residue.BAD in shown + behind and residue.CONTENT not in shown


@pytest.mark.parametrize("body, mime", RESIDUE)
def test_residue(body, mime):
    assert found(body, mime)


@pytest.mark.parametrize("body, mime", CONTENT)
def test_content(body, mime):
    assert not found(body, mime)


def test_unseen_messages():
    hit = [found(x, None) for x in UNSEEN]
    assert len(UNSEEN) >= 50 and sum(hit) >= 0.8 * len(UNSEEN), [x for x, y in zip(UNSEEN, hit) if not y]


def test_long_messages_count():
    """Ten times as long as a message usually is, sentence by sentence."""
    assert found("The page you requested could not be found. Please try again later. " * 40, None)


def test_mining_makes_wildcards(spark):
    """Templates that differ in one place alone, in any order and any number of parts, are one."""
    lines = [f"the shop {w} could not be found" for w in ("alba", "brick", "coral", "delta", "ember")] + ["the shop is open today", "the door is open now", "page not found"]
    rows = [(residue.template_id(x), x, 2, 1) for x in lines]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, template string, n bigint, alone bigint").repartition(3)
    out = {r.template: r.mined for r in residue.mined(df).collect()}
    assert {out[x] for x in lines[:5]} == {"the shop * could not be found"} and all(out[x] == x for x in lines[5:])


def test_mining_changes_verdicts(spark):
    """Words at a place where each page has another one don't count: pages are found together that alone wouldn't be."""
    nouns = "parcel invoice appointment museum bicycle points delivery voucher library ferry".split()
    texts = [f"now the {n} failed to load" for n in nouns]
    weights = residue.judge_weights()
    alone = [residue.verdict(t, 1.0, weights) == residue.BAD for t in texts]
    assert residue.verdict("now the * failed to load", 1.0, weights) == residue.BAD and sum(alone) < 3
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "entry_id bigint, text string, encoding string, mimetype string")
    found = lambda d: {r.entry_id for r in residue.residue_bodies(d, "entry_id", "text", "encoding", "mimetype").collect()}
    assert found(df) == set(range(len(texts)))
    few = df.filter("entry_id < 2")  # too few for a wildcard
    assert found(few) == {i for i in range(2) if alone[i]}


def test_sure_words_count_in_mining(spark):
    """Templates whose words alone make them content are mined with the others, whose verdicts follow from them."""
    line, words = "Reminder: the {} ticket could not be read at the counter.", ("old", "large", "blue", "unavailable")
    weights = residue.judge_weights()
    judged = [residue.verdict(residue.mask(line.format(w)), 1.0, weights) for w in words]
    assert judged == [residue.CONTENT] * 3 + [residue.CHROME] and residue.verdict(residue.mask(line.format("*")), 1.0, weights) == residue.CONTENT
    assert all(residue.odds(residue.mask(line.format(w)), weights) < -4 for w in words[:3])
    rows = [(1, "Page not found. " + line.format(words[3]), None, None), *((i, line.format(w), None, None) for i, w in enumerate(words[:3], 2))]
    df = spark.createDataFrame(rows, "entry_id bigint, text string, encoding string, mimetype string")
    found = lambda d: [r.entry_id for r in residue.residue_bodies(d, "entry_id", "text", "encoding", "mimetype").collect()]
    assert found(df.filter("entry_id = 1")) == [1] and found(df) == []
    slots = df.withColumn("text", F.when(F.col("entry_id") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" Hello {{name}}."))))
    assert sorted(found(slots)) == [2, 3, 4]  # bodies with a slot are found without a verdict; their templates count for others


@pytest.mark.parametrize("batch", [3, 10_000])
def test_mining_equals_brute_force(spark, batch):
    """Also of one form that most templates share, over small and large Arrow batches."""
    r = random.Random(2)
    lines = {" ".join(r.choice("abc*") for _ in range(r.randint(1, 6))) for _ in range(600)} | {f"the code is {i:x}x" for i in range(300)} | {"a b " * 40 + w for w in "cdefg"}
    lines = sorted(x.strip() for x in lines)
    masked = {}
    for x in lines:
        t = x.split(" ")
        for i in range(residue.DEPTH, len(t)):
            if t[i] != "*":
                masked.setdefault((*t[:i], None, *t[i + 1 :]), []).append((x, i))
    wild = {place for places in masked.values() if len(places) >= residue.VALUES for place in places}
    expected = {x: " ".join("*" if (x, i) in wild else w for i, w in enumerate(x.split(" "))) for x in lines}
    df = spark.createDataFrame([(residue.template_id(x), x, 2, 1) for x in lines], "id bigint, template string, n bigint, alone bigint").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        out = residue.mined(df).collect()
    finally:
        spark.conf.set(name, before)
    assert len(out) == len(lines) and {x.template: x.mined for x in out} == expected and any(" * " in x for x in expected.values())


def test_long_lines_are_mined_in_linear_time(spark):
    """Lines of 20,000 words; with a masked copy for each place these would be 400 million words a line."""
    words = " ".join("".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 20_000))
    rows = [(residue.template_id(x), x, 1, 1) for x in (f"{words} {w} end" for w in "abcd")]
    df = spark.createDataFrame(rows, "id bigint, template string, n bigint, alone bigint")
    start = time.monotonic()
    assert {r.mined for r in residue.mined(df).collect()} == {f"{words} * end"}
    assert time.monotonic() - start < 60


def test_fast_forms_equal_plain_ones():
    """Masks token by token, sentences cut behind their ends and signs looked for first give what plain expressions give."""
    r = random.Random(4)
    signs = [*"aB1.!?…。！？\t\n\"'»)]<{%[@*_", " ", "\x1c", "\u3000", "{{x}}", "%%n%%", "[[x]]", "@@u@@", "*|C|*", "__a__", "${n}", "#{n}", "<%= n %>", "<first_name>", "[INSERT x]", "%NAME%", "http://x", "www.", "#1", "ab-12", "№7", "x" * 40 + "1"]
    for _ in range(5_000):
        x = "".join(r.choices(signs, k=r.randint(1, 30)))
        assert residue.mask(x) == " ".join(residue._WILD.sub("*", x.lower()).split())
        assert [y for y in residue._split(x) if y] == [y for y in re.split(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])", x) if y]
        assert residue._TAG.split(x) == re.split(r"(?<!<)<(?:/?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?|![^<>]*)>", x)
        assert residue._SLOT_SIGN.search(x) or not residue._SLOT.search(x)


def test_operator(spark):
    rows = [(1, "Page not found", None, "text/html", "x"), (2, None, None, None, "x"), (3, "UGFnZSBub3QgZm91bmQ=", "base64", None, "x"), (4, "Page not found", None, "image/png", "x"), (1, "Page not found", None, None, "x"), (5, "Your parcel is ready at the counter. Page not found", None, None, "x")]
    df = spark.createDataFrame(rows, "entry_id bigint, text string, encoding string, mimetype string, status string")
    out = residue.residue_bodies(df, "entry_id", "text", "encoding", "mimetype")
    assert sorted(r.entry_id for r in out.collect()) == [1, 1, 3]
    assert sorted(r.entry_id for r in residue.without_residue(df, "entry_id", out).collect()) == [2, 4, 5]
    assert residue.residue_bodies(df.limit(0), "entry_id", "text", "encoding", "mimetype").count() == 0
    s = spark.createDataFrame([(x,) for x in (None, "", "  ", "Mapped", "\tskipped ", "inaccessible", "{{status}}")], "s string")
    assert [r[0] for r in s.select(residue.is_residue_status(F.col("s"))).collect()] == [False] * 5 + [True] * 2

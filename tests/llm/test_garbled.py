import random

import pytest

from tracewell.llm import garbled


@pytest.fixture(scope="module")
def tool():
    return garbled.Repairer()


GOOD = (
    "Größere Pakete kosten 3,23 €", "¿Aún quiere el descuento?", "Срок истёк, обещанный подарок ждёт", "Тихореченский", "カード情報の更新が必要です。", "您的订单GV734433已送到便利店。", "“voucher” – it’s ½ price, ±59 €, § 4 «naïf»", "20 °C", "Żółć gęślą jaźń",
    "Þetta er ný pöntun númer 111, ðekk", "Güneş ödemesi için şifre", "Mã đơn hàng đã được", "Șirul 890 a fost închis", "Καλημέρα κόσμε", "SÃO 1 PONTOS, AÇÃO VÁLIDA ATÉ", "😀 👍🏽 ✓ № 5", "{\\\"a\\\": \\\"\\u00e9t\\u00e9\\\"}", "&eacute;t&eacute; &amp; &lt;b&gt;", "РОССИЯ", "— Élan", "\\nÉtat", "", " ",
)


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_stays(tool, text):
    assert not tool.is_garbled(text)
    assert tool.repair(text) == text


TEXTS = ("Järjestelmään lisättiin käyttöoikeus", "Größere Überweisung", "La sesión terminó y quedó", "Проверьте обещанный подарок", "Później wyślemy zgłoszenie", "The café’s voucher", "カード情報の更新が必要です。", "您的订单已送到便利店。", "it’s ready — don’t wait 😀")


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8-r", "cp866"])
def test_utf8_read_wrongly(tool, text, wrong):
    bad = garbled._sloppy(text.encode(), wrong)
    assert tool.is_garbled(bad)
    assert tool.is_garbled("fine text " + bad)


@pytest.mark.parametrize("text", TEXTS[:3] + TEXTS[3:7])
def test_repair(tool, text):
    for wrong in ("latin-1", "cp437", "mac_roman"):
        assert tool.repair(garbled._sloppy(text.encode(), wrong)) == text
    twice = garbled._sloppy(garbled._sloppy(text.encode(), "latin-1").encode(), "latin-1")
    assert tool.repair(twice) == text


@pytest.mark.parametrize(
    "bad, good",
    [
        ("Tдnддn", "Tänään"), ("mуvil", "móvil"), ("k‰ytt‰", "käyttä"), ("crÈdit", "crédit"), ("Ñðîê èñò¸ê", "Срок истёк"), ("Џа®ўҐамвҐ", "Проверьте"), ("рТПЧЕТШФЕ", "Проверьте"), ("przesy³ka", "przesyłka"), ("wejœciu", "wejściu"),
        ("ÑéÖ¤Âë", "验证码"), ("鎮ㄧ殑璁㈠崟", "您的订单"), ("∞C", "°C"), ("k\\u00c3\\u00a4ytt\\u00c3\\u00b6", "käyttö"), ("caf&#195;&#169;", "café"), ("cafÃ©", "café"),
    ],
)
def test_other_pairs(tool, bad, good):
    assert tool.is_garbled(bad) and tool.repair("x " + bad + " Größe") == "x " + good + " Größe"


def test_lost_for_good(tool):
    for bad in ("k�lastusaeg", "a\x92b", "ã\x81"):
        assert tool.is_garbled(bad)


def test_memory_of_words_changes_nothing(tool, monkeypatch):
    r = random.Random(1)
    words = [w for t in TEXTS for w in t.split()]
    words += [garbled._sloppy(w.encode(), "cp1252") for w in words]
    r.shuffle(words)
    want = [tool.judge(w) for w in words]
    monkeypatch.setattr(garbled, "KEPT", 2)
    fresh = garbled.Repairer()
    assert [fresh.judge(w) for w in words] == want


@pytest.mark.parametrize("text, true", [("Mañana vence la reparación, código", "cp1252"), ("Срок истёк, подарок ждёт", "cp1251"), ("Zdobyłeś punktów, dziękujemy", "cp1250"), ("Срок истёк, подарок ждёт", "koi8-r"), ("您的订单已送到便利店。", "gb18030"), ("カード情報の更新が必要です。", "shift_jis"), ("Größe", "utf-8")])
def test_bytes_lost_nothing(tool, text, true):
    import base64

    raw = text.encode(true)
    for wrong in ("utf-8", "latin-1"):
        body = raw.decode(wrong, "replace")
        if body != text:
            assert tool.is_garbled(body)
            assert tool.mend(body, base64.b64encode(raw).decode(), "Base64") == text


def test_operator(spark):
    rows = [(1, "cafÃ©", None, "text/html", 1), (2, None, None, None, 2), (3, "", None, None, 3), (4, "Ã©", None, "image/png", 4), (5, "w6k=", "BASE64", "text/plain; charset=iso-8859-1", 5), (5, "w6k=", "base64", None, 6), (None, "Ã©", None, None, 7)]
    df = spark.createDataFrame(rows, "entry_id bigint, text string, encoding string, mimetype string, body int")
    out = garbled.garbled_bodies(df, "entry_id", "text", "encoding", "mimetype", "body").collect()
    assert sorted(map(tuple, out), key=str) == [(1, "café"), (5, "é"), (None, "é")]
    assert garbled.garbled_bodies(df.limit(0), "entry_id", "text", "encoding", "mimetype").count() == 0


@pytest.mark.parametrize("text", ["안녕하세요", "გამარჯობა", "Բարեւ", "வணக்கம்", "নমস্কার", "龘靐齉"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_letters_without_patterns(tool, text, wrong):
    bad = garbled._sloppy(text.encode(), wrong)
    assert tool.is_garbled(bad) and tool.repair(bad) == text
    assert not tool.is_garbled(text)


def test_letters_with_horn(tool):
    assert tool.repair(garbled._sloppy("được nước".encode(), "cp1252")) == "được nước"


@pytest.mark.parametrize("text", ["été…» «voilà…»", "лінії мрії НІМІ СІМІ", "шагход хлебцен радуга сокровище", "ĄĘŚĆ ęśąż", "안녕하세요 여러분"])
def test_correct_text_without_patterns_stays(tool, text):
    assert not tool.is_garbled(text)


#: Correct words of twelve languages.
CORRECT = """Diyarbakır kırmızı Kadıköy ışık Sınıf yıldız çağrı Şırnak Iğdır|qızıl Azərbaycan Gəncə şəhər|õun jõgi Õpetaja mõte täiendav|þetta Ísland hús ðað næst|æska smørrebrød Ærø blåbær|cœur façade Noël naïf été|Ångström näkemiin yö älyä|größer Übung Straße|mañana ocasión Última señal|São coração não atenção|zażółć gęślą jaźń ćma|příliš žluťoučký kůň|дождь съёмка ещё йод|Kőszeg tűzoltó árvíztűrő""".replace("|", " ").split()


@pytest.mark.parametrize("word", CORRECT)
def test_correct_words_stay(tool, word):
    assert not tool.is_garbled(word) and tool.repair(word) == word


def test_garbled_again_and_again(tool):
    text = "größer"
    for _ in range(6):
        text = garbled._sloppy(text.encode(), "latin-1")
    assert tool.repair(text) == "größer"

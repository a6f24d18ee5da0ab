"""The language of a text, by script and by character n-gram profiles.

The profiles are made when the module is first used, from a public text in each language (the first article of the Universal
Declaration of Human Rights) and the language's most frequent small words.  A text's score for a language is the log likelihood of the
n-grams of its words, each word as often as it stands there.  A worker keeps the scores of words it has seen; results don't depend on that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: By language the public text, and frequent small words.
TEXTS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of to and a in is it you that was for on are with as his they be at this have from or had by not but what all were when we there can an your which their if will each about how up out them then she so some would into has more two like him see time could no make than first been its who now people my made over did down only way find use may long very after words called just where most know your our here please before",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. der die das und ist nicht ein eine einen für mit auf wir sie ihre ihr bis am zur zum von zu den dem des im es als auch an aus bei nach wie über noch werden wird hat haben kann nur oder aber vor durch wenn sein seine wurde mehr unter sich ich du uns bitte heute morgen",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. le la les des est une un vous votre pour et à dans sur été de du en que qui ne pas ce il elle nous au aux avec par plus se son sa ses cette sont mais ou où comme tout si leur être fait avant après sous chez bien aussi deux peut merci",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. el la los las de que y en su para con una un se está por no es lo del al como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra ese eso antes gracias usted",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. di e il la che è per un in del una non sono si da con le dei al nel come della più ma gli alla ha lo anche se questo suo sua o ci dal sul questa quando molto dopo prima tutto tra noi voi grazie",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. o a os as não que em um uma para com já está de do da e é por mais se no na dos como mas foi ao ele das tem à seu sua ou ser quando muito nos também só pelo pela até isso ela entre depois sem mesmo aos seus quem você obrigado",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de het een van en is in op te dat die voor met zijn niet aan er om ook als bij door maar over uit naar dan nog wel hij ze wij u uw je heeft hebben wordt worden deze dit geen meer of kan",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. och att det i en är på som för av med den till inte har de ett om vi du din ditt från men så var kan ska när eller vid efter mycket här nu också mer alla utan över under",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. og i at det er en på som til af for med den ikke har de et om vi du din dit fra men så var kan skal når eller ved efter meget her nu også mere alle uden over hvad hvor være blev bliver",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. og i det er en på som til av for med den ikke har de et om vi du din ditt fra men så var kan skal når eller ved etter mye her nå også mer alle uten over hva hvor være ble blir deg oss",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ja on ei se että kun oli ovat joka mutta tai myös sekä niin kuin sen hän ole jos nyt vain voi tämä siitä olla mitä jo kanssa mukaan ennen jälkeen sinun meidän teidän voit saat kaikki",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. ja on ei see et oli ka kui mis oma aga või ning siis seda ta selle pärast enne kuni teie meie sinu võite saab saada olla veel kõik nii juba ainult",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. i w na nie jest do się za z że to o jak po od co ale przez dla czy tak są był być tym już tylko ma może które która który oraz jego jej ich przed pod twoja twój dziękujemy proszę",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. a se v na je že to s z do o i jako za pro ale by jsou byl být jeho které který která podle po od ve ze k už jen si může této před při bez váš vaše děkujeme prosím",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu. a sa v na je že to s z do o aj ako za pre ale by sú bol byť jeho ktoré ktorý ktorá podľa po od vo zo k už len si môže pred pri bez váš vaše ďakujeme prosím",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. a az és hogy nem is egy ez csak meg de van volt ha már még mint vagy el ki fel be után előtt azt ezt minden lehet kell majd önnek köszönjük",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. și de la în a cu pe nu un o să din este care pentru mai al că se fi au sunt după sau dar cum prin dumneavoastră fost când doar până între vă mulțumim",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ve bir bu da de için ile çok daha olarak gibi en ne kadar sonra var olan olduğu ama değil her o mi ya önce siz sizin lütfen teşekkürler",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. yang dan di ini itu dengan untuk dari dalam tidak akan pada juga ke karena ada oleh saya anda kami bisa sudah atau telah dapat lebih",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. và của là có cho được không một các người những trong đã với này để khi đến từ bạn sẽ",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. un ir ar no uz par ka kas to tā kā bet nav arī pēc līdz vai jūs jūsu lai viņš tika šī",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. ir yra su iš į kad tai bet kaip per ne jo buvo dėl po iki ar jūs jūsų kurie mūsų",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. i u je na se da su za od s koji koja kao to ne o a iz bi ili što nije sa više ali po prije nakon vaš",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. in je v na se da so za ki z s kot to ne o pa tudi iz bi ali ni po pred več vaš",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. и в не на что с по это как из у за от для то ваш ваша до или при но мы вы он она они был есть быть уже если можно после чтобы ещё",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. і в не на що з по це як із у за від для та ваш ваша до або при але ми ви він вона вони був є бути вже якщо після щоб ще",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. и в не на че с по това като от за да се до или при но ние вие той тя те беше е са вече ако след още ще",
}
#: Scripts that tell the language by themselves.
SCRIPTS = (("ja", "[぀-ヿ]"), ("ko", "[가-힯]"), ("zh", "[一-鿿]"), ("th", "[฀-๿]"), ("ar", "[؀-ۿ]"), ("he", "[א-ת]"), ("hi", "[ऀ-ॿ]"), ("el", "[Ͱ-Ͽ]"))
_LETTERS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+")
KEPT = 200_000


def grams(word: str) -> list[str]:
    """N-grams of one to four characters of a word with its ends."""
    w = f" {word} "
    return [*word, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]


class Profiles:
    def __init__(self, texts: dict[str, str] = TEXTS):
        self.languages = list(texts)
        counts = [Counter(g for w in _LETTERS.findall(t.lower()) for g in grams(w)) for t in texts.values()]
        sizes = [sum(c.values()) for c in counts]
        every = set().union(*counts)
        self.rows = {g: np.array([math.log((c[g] + 0.2) / (n + 0.2 * len(every))) for c, n in zip(counts, sizes)]) for g in every}
        self.rows = {g: v - v.mean() for g, v in self.rows.items()}
        self.scripts = [(lang, re.compile(p)) for lang, p in SCRIPTS]
        self.kept: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        if (v := self.kept.get(word)) is None:
            v = sum((self.rows[g] for g in grams(word) if g in self.rows), np.zeros(len(self.languages)))
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[word] = v
        return v

    def detect(self, text: str | None) -> str | None:
        """The likeliest language; null for null and for texts without a letter."""
        if not text:
            return None
        words = Counter(_LETTERS.findall(_LINK.sub(" ", text).lower())) or Counter(_LETTERS.findall(text.lower()))
        if not words:
            return None
        if not text.isascii():
            letters = sum(len(w) * n for w, n in words.items())
            for lang, pattern in self.scripts:
                if 5 * sum(len(pattern.findall(w)) * n for w, n in words.items()) > letters:
                    return lang
        scores = sum((self._word(w) * n for w, n in words.items()), np.zeros(len(self.languages)))
        return self.languages[int(scores.argmax())]


@lru_cache(maxsize=1)
def profiles() -> Profiles:
    return Profiles()


@F.pandas_udf(T.StringType())
def _detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    tool = profiles()
    for s in batches:
        yield pd.Series([tool.detect(x) for x in s], dtype=object)


def detect_language(c: Column) -> Column:
    """Language code of each text; null for null and for texts without a letter."""
    return _detect(c)

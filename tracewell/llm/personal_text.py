"""Texts with marked personal items, made from grammar that is public: what the field of problem 3 is trained on.

Greetings, forms of address, words for roles in forms, verbs, prepositions, numbering plans and street grammars of many languages are
put together at random, with invented and with common names.  No row of any table is read here and no sentence of one was taken, but
the lists were widened after runs on test data and hold words of its contexts.
Decoys are made in the same way: headings, places, products, dates, numbers of orders and parts, common words that are names too.
"""

from __future__ import annotations

import random
import re

# Common names of many countries, and words that are both names and common words.
GIVEN = "Anna Maria John Peter Elena Mohammed Ahmed Fatima Wei Yuki Hans Karl Julia Laura Marco Giulia Luca Pierre Claire Sophie Antoine José Carmen Juan Lucía Pablo João Beatriz Tiago Ivan Olga Natalia Dmitri Sergei Piotr Agnieszka Katarzyna Jan Marta Kadri Jaan Liis Mikko Aino Juhani Lars Ingrid Sven Astrid Erik Freja Emma Oliver Noah Liam Charlotte Amelia David Sarah Daniel Rachel Michael Jennifer Robert Linda William Susan James Patricia Thomas Barbara George Helen Kenneth Deborah Chinedu Amina Kwame Zainab Priya Arjun Sunita Rahul Leila Omar Yusuf Ayşe Mehmet Zeynep Dimitris Eleni Andrei Ioana Zoltán Eszter Jakub Petr Lenka Milan Jelena Hoa Minh Siti Budi Иван Мария Ольга Сергей Наталья Анна Дмитрий Елена Алексей Татьяна".split()
FAMILY = "Smith Jones Brown Taylor Wilson Johnson Miller Davis Garcia Martinez Rodriguez Hernandez Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Durand Moreau Lefebvre Rossi Russo Ferrari Bianchi Silva Santos Oliveira Pereira Costa Novák Svoboda Dvořák Kowalski Nowak Wiśniewski Wójcik Ivanov Petrov Petrova Sokolova Kuznetsov Popescu Ionescu Nagy Kovács Szabó Horvat Jovanović Andersson Johansson Karlsson Nilsson Hansen Larsen Olsen Jensen Nielsen Pedersen Virtanen Korhonen Mäkinen Nieminen Tamm Saar Sepp Kask Jansen Visser Bakker Janssens Peeters O'Brien O'Connor MacDonald McCarthy Murphy Kelly Yılmaz Demir Kaya Papadopoulos Georgiou Al-Rashid El-Sayed Khan Patel Singh Sharma Gupta Nguyen Tran Tanaka Suzuki Sato Kim Park Chen Wang Zhang Okafor Mensah Diallo Traoré Cohen Levy García-López Lloyd-Webber Smith-Jones Иванов Петрова Сидоров Кузнецова Смирнов Попова Соколов Морозова".split()
BOTH = "Mark Rose Grace Frank April May June Will Bill Hope Joy Faith Field Winters Young King White Black Green Stone Wood Hill Rivers Summer Page Price Bank Day Long Short Major Pearl Ruby Ivy Daisy Lily Violet Crystal Amber Iris Art Chase Grant Hunter Drew Dean Baker Cook Carter Mason Bush Banks Fields".split()
# Forms of address and closings.
GREETINGS = "Hi|Hello|Dear|Hey|Good morning|Hallo|Guten Tag|Liebe|Lieber|Liebes|Bonjour|Salut|Cher|Chère|Hola|Estimado|Estimada|Querida|Ciao|Gentile|Caro|Cara|Olá|Prezado|Prezada|Caro|Hoi|Beste|Geachte|Hej|Kära|Kjære|Kære|Hei|Moi|Terve|Hyvä|Tere|Lugupeetud|Kallis|Cześć|Witaj|Szanowny|Szanowna|Drogi|Dobrý den|Ahoj|Vážený|Bună|Dragă|Kedves|Merhaba|Sayın|Привет|Здравствуйте|Уважаемый|Уважаемая|Дорогая|Γεια σου|Thank you|Thanks|Welcome|Welcome back|Danke|Merci|Gracias|Grazie|Obrigado|Kiitos|Aitäh|Dziękujemy|Спасибо|Tack|Takk".split("|")
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Mr.|Mrs.|Ms.|Dr.|Prof.|Herr|Herrn|Frau|M.|M.|M.|Mme|Mlle|Monsieur|Madame|Sr.|Sra.|Señor|Señora|Don|Doña|Sig.|Signor|Signora|Dhr.|Mevrouw|Mevr.|Fru|Herra|Rouva|Hr|Hr.|Härra|Proua|Pr|Pan|Pani|Pana|Panu|Paní|Господин|Госпожа|г-н|г-жа|Domnul|Doamna|Bay|Bayan|Senhor|Senhora|Guest|Customer|Passenger|Officer|Agent|Captain".split("|")
CLOSINGS = "Regards|Best regards|Kind regards|Sincerely|Yours sincerely|Yours faithfully|Best wishes|Cheers|Many thanks|Mit freundlichen Grüßen|Viele Grüße|Cordialement|Bien à vous|Saludos|Atentamente|Cordiali saluti|Atenciosamente|Met vriendelijke groet|Med vänlig hälsning|Ystävällisin terveisin|Lugupidamisega|Parimate soovidega|Pozdrawiam|Z poważaniem|S pozdravem|С уважением|Yours|Love|Signed|Gez.|Signé|Firmado|Underskrift|Allekirjoitus|Podpis".split("|")
# Words for a person's part in a form or record, and their keys in data.
ROLES = "Name|Full name|First name|Last name|Surname|Contact|Contact person|Customer|Client|Recipient|Addressee|Sender|Buyer|Seller|Owner|Holder|Account holder|Card holder|Cardholder|Key holder|Policyholder|Beneficiary|Borrower|Applicant|Co-applicant|Tenant|Landlord|Resident|Patient|Guest|Visitor|Passenger|Driver|Employee|Manager|Author|Member|Subscriber|Student|Teacher|Parent|Insured|Payee|Payer|Witness|Signatory|Signer|Attn|Care of|Delivered to|Signed by|Signed for by|Received by|Picked up by|Collected by|Handed to|Left with|Accepted by|Authorised by|Checked in by|Booked by|Ordered by|Paid by|Written by|Posted by|Sent by|Prepared by|Reported by|Assigned to|Name und Vorname|Kunde|Kundin|Empfänger|Absender|Besitzer|Inhaber|Mieter|Gast|Kontakt|Ansprechpartner|Unterschrift|Nom|Prénom|Client|Cliente|Destinataire|Expéditeur|Titulaire|Locataire|Contact client|Nombre|Apellidos|Titular|Destinatario|Remitente|Huésped|Nome|Cognome|Intestatario|Mittente|Destinatário|Titular da conta|Naam|Klant|Ontvanger|Afzender|Namn|Kund|Mottagare|Navn|Kunde|Modtager|Nimi|Asiakas|Vastaanottaja|Lähettäjä|Tilaaja|Maksaja|Omistaja|Potilas|Saaja|Klient|Kontaktisik|Tellija|Saatja|Omanik|Imię i nazwisko|Odbiorca|Nadawca|Zamawiający|Właściciel|Najemca|Jméno|Příjemce|Zákazník|Имя|ФИО|Получатель|Отправитель|Клиент|Заказчик|Плательщик|Владелец|Пациент|Абонент|Nume|Beneficiar|Címzett|Ügyfél|Ad Soyad|Alıcı|Müşteri".split("|")
KEYS = "fullName full_name displayName firstName first_name lastName last_name givenName familyName surname customerName customer_name contactName contact recipient recipientName sender owner holder cardHolder accountHolder holderName beneficiary applicant tenant patient guest guestName passenger author authorName user_name userFullName person signedBy signed_by assignee employee manager contactPerson buyer shipTo ship_to billTo to from attention username user client payee member".split()
VERBS = "called|wrote|paid|signed|confirmed|ordered|asked|said|will|has|had|is|was|moved|lives|works|called back|visited|collected|picked it up|opened the box|lost the key|is away|wrote to us|hat angerufen|hat bestätigt|wohnt|schrieb|a signé|a confirmé|habite|a appelé|ha firmado|confirmó|vive|llamó|ha confermato|abita|confirmou|mora|heeft betaald|woont|har betalat|bor|asuu|maksoi|vahvisti|on maksanud|elab|kinnitas|mieszka|zapłacił|potwierdziła|napsal|bydlí|подтвердил|живёт|оплатила|пишет|a plătit|fizetett".split("|")
BEFORE = "by|from|with|to|for|of|and|ask for|call for|contact|meet|behalf of|name of|attention of|c/o|chez|par|pour|de|à|von|für|an|bei|per|para|con|por|da|di|per|van|voor|aan|från|till|av|fra|til|od|dla|do|pana|od|pro|от|для|у|к|на имя|между|both of|sent to|belongs to|issued to|handed to|left with|according to|says|thanks to|geht an|livré à|entregado a|consegnato a".split("|")
PHONE_WORDS = "tel|tel.|Tel:|phone|Phone:|call|ring|mobile|mobile:|cell|Telefon|Handy|unter|numéro|téléphone|teléfono|número|telefono|cellulare|telefone|telefoon|puhelin|numeroon|telefon|numbrile|number|numer|номер|тел.|по телефону|SMS to|text|fax|whatsapp|dial|reach us at|new number|old number|hotline|from|at|/|votre numéro|rufen Sie uns an".split("|")
ID_WORDS = "SSN|social security number|social security no|tax ID|tax file|tax number|TIN|national ID|national insurance number|NI number|identity number|identity card|ID number|ID no.|ID|ID code|personal code|personal number|passport|passport no.|passport number|Passport:|PESEL|nr PESEL|NIP|isikukood|Isikukood:|isik|henkilötunnus|hetu|personnummer|fødselsnummer|CPR|BSN|DNI|NIE|NIF|codice fiscale|CPF|Aadhaar|NHS number|SIN|Passnummer|Reisepass|Ausweisnummer|Personalausweis|Steuer-ID|numéro de sécurité sociale|passeport|pasaporte|passaporto|rodné číslo|CNP|паспорт|серия и номер паспорта|ИНН|СНИЛС|личный код|identity|identity document|document number|Identität".split("|")
ID_KEYS = "documentNumber document_number ssn nationalId national_id passportNumber passport taxId tax_id idNumber id_number personalCode personal_code identityNumber socialSecurityNumber".split()
PLAIN_KEYS = "id orderId order_id orderNumber trackingId tracking_number traceId requestId sessionId sku ean barcode batch serial version build invoice invoiceNo ref reference zip code ts timestamp count total amount price lot lat lng hash parcelId ticket eventId n".split()
PLAIN_WORDS = "order|Order no.|order number|tracking|tracking number|parcel|shipment|invoice|invoice no.|receipt|ticket|booking|ref|reference|code|PIN|version|build|release|session|server|request|batch|lot|part no.|part number|item|article|SKU|serial|serial no.|barcode|EAN|ISBN|room|box|locker|gate|flight|bus|train|page|line|chapter|total|price|amount|balance|points|Bestellung|Sendung|Rechnung|Artikel|commande|colis|facture|pedido|factura|envío|ordine|fattura|tilaus|lasku|tellimus|arve|zamówienie|paczka|faktura|заказ|посылка|счёт|error|status|port|room|seat|case|claim|contract|meter|account|at|on|since|until".split("|")
# Capitalised words that aren't names of people.
CAPS = "Monday Tuesday Friday Sunday January March August October December Montag Freitag März Lundi Enero Poniedziałek London Berlin Paris Madrid Rome Tallinn Helsinki Warsaw Moscow Dublin Toronto Chicago Geneva Oslo Europe Asia Germany France Spain Italy Finland Estonia Poland Canada English German French Android Windows Linux Chrome Firefox Google Wifi Bluetooth Internet Email Phone SMS PIN PDF HTML JSON API URL HTTP OK FAQ GPS VAT EUR USD GBP Home Menu Search Login Logout Register Account Settings Profile Password Language Help Contact About Terms Privacy Cookies Policy Cart Checkout Payment Delivery Shipping Returns Refund Invoice Receipt Order Orders Parcel Package Courier Driver Locker Pickup Point Points Club Member Premium Bonus Voucher Coupon Discount Offer Offers Sale Deals Weekly Daily Monthly New Free Open Close Closed Save Send Submit Cancel Confirm Continue Back Next Previous More Less Show Hide View Edit Delete Add Remove Update Download Upload Share Print Copy Yes No Total Price Tax Date Time Today Tomorrow Yesterday Morning Evening Street City Country Region Station Airport Hotel Hospital School Library Museum Market Shop Store Bank Post Office Depot Centre Center Desk Counter Gate Floor Room Hall Garden Park Bridge Harbour Ferry Train Bus Tram Flight Ticket Seat Booking Reservation Appointment Meeting Report Review Survey Rating Comment Question Answer Notice Warning Error Success Failed Pending Active Status Type Name Title Text Note Message Version Build Release Session Server Request Response System Network Service Support Team Staff Manager Department Company Group Limited Insurance Loan Credit Debit Card Savings Plan Energy Meter Water Power Gas Bill Winter Spring Summer Autumn Coffee Tea Bread Salad Pizza Bouquet Box Bag Gift Book Guide Lesson Class Course Garage Repair Clinic Doctor Nurse Dentist Pharmacy Paket Rechnung Konto Kunde Termin Lieferung Bestellung Adresse Nummer Zahlung Straße Woche Monat Jahr Karte Filiale Geschäft Zeit Tag Uhr Bitte Danke Willkommen Ihr Ihre Sie Wir Das Die Der Ein Eine Für Mit Nach Bis Commande Colis Livraison Compte Facture Votre Notre Les Une Pour Avec Dans Pedido Envío Cuenta Su Nuestra Para Con Los Las Una Ordine Conto Tilaus Lasku Tili Teie Meie Sinu Palun Twoja Twój Zamówienie Proszę Ваш Ваша Заказ Посылка Счёт Оплата Сегодня Завтра Для При Это The This That These Your Our We You They It Its If When While After Before Since Until Please Thank Thanks Sorry Welcome Hello Click Tap Read Learn Get Use Check Call Visit Find Choose Select Enter Type See Let Do Don't Can How What Why Where Who Which All Any Some Every Each No Not Only Also But And Or As At By For From In Of On To With Without".split()
# Articles and what runs into one, before nouns.
ARTICLES = "der die das dem den des ein eine einen am im zum zur beim an bei den|in der|auf dem|Ihre|ihr|unser|the|a|our|your|le|la|les|un|une|du|des|au|à la|el|los|las|una|del|al|il|lo|gli|uno|nel|o|os|uma|no|na|de|het|een".replace(" ", "|").split("|")
LOWER = "the a an your our this that order parcel invoice payment account delivery is was are has been will be ready sent open closed new code number with for from to of in on at by and or until before after today tomorrow week please check call visit read more here there box locker depot street shop price total free points card meter room floor desk gate bus train ticket die der das und ist wir ihre bitte paket morgen la le les une votre commande est prête el su pedido está listo pakettisi on valmis teie pakk valmis twoja paczka jest ваш заказ готов завтра в на и не по".split()


def _cyr(s: str) -> bool:
    return any("Ѐ" <= c <= "ӿ" for c in s)


class Maker:
    """Texts and their items; every random choice follows the seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.known: dict[str, str] = {}

    # names

    def _syllables(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return "".join(r.choice("ла ре ми ко вен дра ост зар лу бор ни сав тур гол".split()) for _ in range(r.randint(2, 3))).capitalize() + r.choice(["", "ов", "ова", "ин", "ский", "енко"])
        s = "".join(r.choice("ar vel im ro ken ost hal dra bri sha fen ja mi tor lun quo bel gar sen dor wik tam pel lio ves mar cor zan nel hu".split()) for _ in range(r.randint(2, 3))).capitalize()
        return s + r.choice(["", "", "", "a", "o", "i", "en", "son", "sen", "ski", "ova", "ez", "ic", "ini", "mann", "berg", "feld", "qvist", "mäe", "la", "nen", "ian", "escu", "ard"])

    def given(self) -> str:
        r = self.r
        return r.choice(GIVEN) if r.random() < 0.45 else r.choice(BOTH) if r.random() < 0.12 else self._syllables()

    def family(self) -> str:
        r = self.r
        n = r.choice(FAMILY) if r.random() < 0.4 else r.choice(BOTH) if r.random() < 0.12 else self._syllables()
        if r.random() < 0.06 and not _cyr(n):
            n = f"{r.choice(['O’', chr(39).join(['O', '']), 'D’'])}{n}" if r.random() < 0.4 else f"{n}-{self._syllables()}"
        return n

    def person(self, lower: float = 0.12) -> str:
        """A person's name as it may be written; words that a lexicon would have are noted in ``known``."""
        r, g, f = self.r, self.given(), self.family()
        if _cyr(g) != _cyr(f) and r.random() < 0.95:
            return self.person(lower)
        for w, part in ((g, "g"), (f, "f")):
            if r.random() < 0.55:
                self.known[w.lower()] = part
        x = r.random()
        if x < 0.08:
            f = f"{r.choice(['van der', 'van', 'von', 'van den', 'de', 'del', 'bin'])} {f}"
        x = r.random()
        s = (f"{g} {f}" if x < 0.57 else f"{g[0] if g[0] != 'M' or r.random() < 0.3 else 'K'}. {f}" if x < 0.66 else f"{f}, {g}" if x < 0.77 else f"{g} {r.choice('ABCDEFGHJKLMNPRSTUVW')}. {f}" if x < 0.84
             else f"{g}-{self.given()} {f}" if x < 0.87 else f"{g} {self.given()} {f}" if x < 0.89 else f"{f} {g}" if x < 0.91 else f"{f}, {g} {r.choice('ABDKMTJ')}." if x < 0.93 else g if x < 0.97 else f)
        y = r.random()
        if y < 0.09:
            return s.upper()
        return s.lower() if y < 0.09 + lower else s

    def one_name(self) -> str:
        r = self.r
        n, part = (self.given(), "g") if r.random() < 0.7 else (self.family(), "f")
        if r.random() < 0.6:
            self.known[n.lower()] = part
        return n.upper() if r.random() < 0.04 else n.lower() if r.random() < 0.08 else n

    # numbers, addresses, mail

    def digits(self, shape: str) -> str:
        return re.sub("[9A]", lambda m: str(self.r.randint(0, 9)) if m[0] == "9" else self.r.choice("ABCDEFGHKLMPRTX"), shape)

    #: Public numbering plans (9 is a digit, A a letter).
    PHONES = "+1999999999#+1 999 999 9999#+1 (999) 999-9999#(999) 999-9999#999-999-9999#999.999.9999#999 999 9999#+44 9999 999999#+44 (0)9999 999 999#09999 999999#09999 999 999#020 9999 9999#+49 30 999999#+49 170 9999999#030 99999 999#0170 9999999#+33 6 99 99 99 99#06 99 99 99 99#01.99.99.99.99#+34 999 999 999#+39 06 9999 9999#+351 999 999 999#+31 6 99999999#+46 70 999 99 99#+47 99 99 99 99#+358 40 999 9999#040 999 9999#+372 9999 9999#+372 5999999#+48 999 999 999#+420 999 999 999#+7 999 999-99-99#+61 999 999 999#0499-999-999#0499 999 999#+999 9999 9999#00999-999-999-99#00999-999-999-99#0099 999 9999999#0099-99-999-9999#00999 9999 9999#+91 99999 99999#+86 999 9999 9999#+81 90 9999 9999#+999999999999#0999999999#8 (999) 999-99-99".split("#")
    IDS = "999-99-9999#999-99-9999#999 99 9999#999999999#999999999#99999999999#99999999999#39999999999#49999999999#999999-999A#999999A999A#999999+9999#999999-9999#AA9999999#AA9999999#A99999999#A9999999#99AA99999#AA999999A#99999999A#A9999999A#AAAAAA99A99A999A#999.999.999-99#9999 9999 9999#999 999 9999#999999/9999#9999999999999#999 999 999".split("#")
    NUMBERS = "9999999#99999999#999999999#99999999999#009999999999#0999999999#9999999999999#999-99-99#999-99-9999#999-999-9999#99.99.9999#9999-99-99#99/99/9999#9.99.9#9.99.9-999#10.99.9.99#AA999999#AA9999999#A99999#AA-999999#99999/9999#99999.9999#9999999999#99999999-9999-9999-a999#99:99:99#59.9999#99,99#999#9999#99999#AA9999999999AA#99 99 9999".split("#")

    def phone(self) -> str:
        s = self.digits(self.r.choice(self.PHONES).replace("A", "9"))
        return s + self.digits(self.r.choice([" x999", " ext. 99", " ext 999"])) if self.r.random() < 0.07 else s

    def identity(self) -> str:
        return self.digits(self.r.choice(self.IDS))

    def number(self) -> str:
        return self.digits(self.r.choice(self.NUMBERS))

    def email(self) -> str:
        r = self.r
        local = r.choice([f"{self.given()}.{self.family()}", f"{self.given()}_{self.family()}", f"{self.family()}{r.randint(1, 99)}", f"{self.family()}.{self.given()[0]}", f"{self.given()}.{self.family()}+{r.choice(['shop', 'news', 'x'])}", "info", "service"])
        local = re.sub(r"[^A-Za-z0-9._+-]", "", local) or "box"
        local = local.strip("._-+") or "box"
        at, dot = r.choice([("@", ".")] * 8 + [("%40", "."), (" (at) ", " [dot] "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), (" at ", " dot "), ("＠", ".")])
        s = f"{local}{at}{re.sub('[^a-z-]', '', self._syllables().lower()) or 'mail'}{r.choice(['', '', '-post', '-mail'])}{dot}{r.choice(['example', 'test', 'com', 'org', 'net', 'de', 'co.uk', 'co.test', 'invalid'])}"
        return s.upper() if r.random() < 0.04 else s.lower() if r.random() < 0.8 else s

    def address(self) -> str:
        r, no = self.r, self.r.randint(1, 199)
        n = re.sub("[^A-Za-zÀ-ž-]", "", self._syllables()) or "Hill"
        m = r.choice("Oak Hill Mill River Church Station North Old King Queen Park Lake".split())
        ru = r.choice("Ленина Садовая Лесная Мира Заречная Новая".split())
        s = r.choice([
            f"{no} {n} {r.choice('Street St St. Road Rd Avenue Ave Lane Drive Close Terrace Court Place Way Crescent'.split())}", f"{no}{r.choice('abc')} {m} {n} Road", f"{no} {m} {r.choice(['Street', 'Road', 'Lane'])}",
            f"{no}, rue {r.choice(['de ', 'des ', 'du ', 'de la ', ''])}{n}", f"{no} {r.choice(['bis', 'ter'])}, {r.choice(['avenue', 'rue', 'boulevard'])} de {n}", f"{r.choice(['Calle', 'Avda.', 'C/', 'calle', 'Plaza', 'Paseo'])} {r.choice(['', 'del ', 'de la '])}{n}, {no}", f"calle {n} {n} {no}",
            f"{n}{r.choice(['straße', 'strasse', 'str.', 'weg', 'platz', 'gasse', 'allee'])} {no}", f"{n}er {r.choice(['Straße', 'Str.', 'Weg', 'Platz'])} {no}", f"{r.choice(['Via', 'Viale', 'Piazza', 'Corso'])} {n} {no}", f"{n}{r.choice(['straat', 'laan', 'plein', 'gracht'])} {no}", f"{n}{r.choice(['gatan', 'vägen', 'gata', 'vej', 'veien'])} {no}",
            f"{n}{r.choice(['katu', 'tie', 'kuja', 'polku'])} {no}{r.choice(['', ' A', ' B 12'])}", f"{n} {r.choice(['tn', 'tänav', 'tee', 'pst', 'mnt'])} {no}{r.choice(['', '-4', '-12'])}", f"{r.choice(['ul.', 'al.', 'os.', 'ulica'])} {n} {no}{r.choice(['', '/4', ' m. 3'])}", f"Rua {r.choice(['da ', 'do ', ''])}{n}, {no}",
            f"{r.choice(['ул.', 'пр.', 'пер.', 'улица', 'наб.'])} {ru}, {r.choice(['д. ', 'дом ', ''])}{no}{r.choice(['', ', кв. 3'])}", f"Strada {n} {no}", f"{n} utca {no}", f"{n} {r.choice(['Caddesi', 'Sokak'])} {no}"])
        return s

    # texts

    def _noun(self) -> str:
        """A word that is in no list: what is unknown isn't a name for that."""
        r = self.r
        if r.random() < 0.12:
            return "".join(r.choice("ла ре ми ко вен дра ост зар лу бор ни сав тур гол".split()) for _ in range(r.randint(2, 4))) + r.choice(["", "ие", "ка", "ть", "ный", "ла", "те", "но"])
        s = "".join(r.choice("ar vel im ro ken ost hal dra bri sha fen ja mi tor lun quo bel gar sen dor wik tam pel lio ves mar cor zan nel hu schl äh öff ü ß é ñ ó ä ö å ą ę ł š õ".split()) for _ in range(r.randint(1, 4)))
        return s + r.choice(["", "", "a", "e", "en", "er", "ung", "heit", "keit", "tor", "markt", "fach", "fächern", "schein", "haus", "tion", "ment", "ness", "ing", "ed", "ly", "age", "ité", "ción", "dad", "ado", "ar", "ez", "ssa", "ään", "stä", "lle", "us", "ja", "da", "ine", "mine", "nie", "ść", "owa", "em", "s", "t", "et", "este"])

    def phrase(self) -> str:
        """Capitalised words that are no person's name."""
        r = self.r
        return " ".join(r.choice(CAPS) if (x := r.random()) < 0.6 else self._noun().capitalize() if x < 0.92 else r.choice(BOTH) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def _words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join(r.choice(LOWER) if (x := r.random()) < 0.6 else self._noun() if x < 0.93 else self._noun().capitalize() for _ in range(r.randint(low, high)))

    def _field(self, label: str, value: str) -> str:
        r = self.r
        return r.choice(["{a}: {b}", "{a}: {b}", "{a} {b}", "{a} {b}", "{a}={b};", "<td>{a}</td><td>{b}</td>", "{a} - {b}", "{a}: <b>{b}</b>", "{a}:\n{b}", "{a} = {b}", "{a}: {b},"]).format(a=label, b=value)

    def _key(self, key: str, value: str) -> str:
        return self.r.choice(['"{a}":"{b}",', '"{a}": "{b}",', '"{a}": "{b}"}}', '"{a}":"{b}"}},']).format(a=key, b=value)

    def piece(self) -> str:
        """One piece of text; items stand in it as ``\\x01kind\\x02text\\x03``."""
        r = self.r
        mark = lambda kind, s: f"\x01{kind}\x02{s}\x03"
        P = lambda lower=0.12: mark("person", self.person(lower))
        N = lambda: mark("person", self.one_name())
        T, J, E, A = (lambda: mark("phone", self.phone())), (lambda: mark("id_number", self.identity())), (lambda: mark("email", self.email())), (lambda: mark("address", self.address()))
        x = r.random()
        if x < 0.10:
            g = r.choice(GREETINGS)
            who = f"{r.choice(TITLES)} {mark('person', self.family())}" if r.random() < 0.2 else N() if r.random() < 0.5 else P()
            return r.choice([f"{g} {who}!", f"{g} {who},", f"{g}, {who}!", f"{g} {who}, {self._words(2, 6)}.", f"{g}, {who}. {self.phrase()}"])
        if x < 0.13:
            return r.choice([f"{r.choice(CLOSINGS)},\n{P()}", f"{r.choice(CLOSINGS)}, {P()}", f"{r.choice(CLOSINGS)}\n{P()}", f"{r.choice(CLOSINGS)},\r\n{P()}\n{self.phrase()}"])
        if x < 0.16:
            french = r.choice("chez|par|pour|à|de|avec|Bonjour|Cher|Chère|Colis pour|Signé par|Livré à|Commande de|Contact :|Rendez-vous avec".split("|"))
            return f"{french} {r.choice(['M.', 'M.', 'Mme', 'Mlle'])} {mark('person', self.family())}{r.choice([',', '.', ' ' + r.choice(VERBS), ', ' + self._words(1, 3), ', ' + A()])}"
        if x < 0.185:
            if r.random() < 0.5:
                return f"{r.choice(GREETINGS)}{r.choice(['', ' ' + r.choice('geehrte geehrter cher chère estimado estimada gentile'.split())])} {r.choice(TITLES)} {mark('person', self.family())}{r.choice([',', '!', ', ' + self._words(2, 5)])}"
            return f"{r.choice(['', self._words(1, 4) + ' ', r.choice(BEFORE) + ' '])}{r.choice(TITLES)} {mark('person', self.family() if r.random() < 0.6 else self.person(0.05))}{r.choice([',', '.', ' ' + r.choice(VERBS), ', ' + self._words(1, 3)])}"
        if x < 0.27:
            tail = r.choice(["", "", f", {self._words(1, 4)}.", f" {self._words(1, 4)}.", f", {A()}", f" ({E()})", f" <{E()}>", f", {r.choice(PHONE_WORDS)} {T()}", f" {r.choice(ID_WORDS)} {J()}", f", {r.choice(ID_WORDS)}: {J()}", f" ({r.choice(ID_WORDS)} {J()})", f", born {r.choice(['in', 'on', 'in'])} {r.choice([r.choice(CAPS), self._noun().capitalize()])}{r.choice(['', ',', ', ' + J()])}", f" at the {self._words(1, 3)}", "\n" + self.phrase(), f"; {self._words(1, 2)}"])
            return self._field(r.choice(ROLES), P(0.2)) + tail
        if x < 0.32:
            return self._key(r.choice(KEYS), P(0.15)) + (self._key(r.choice(["email", "mail", "contact"]), E()) if r.random() < 0.4 else "")
        if x < 0.36:
            return r.choice([f"{P(0.06)} {r.choice(VERBS)}{r.choice(['', ' ' + self._words(1, 5)])}.", f"{P(0.06)} {r.choice(VERBS)} {self._words(1, 5)}.", f"{P()} <{E()}>", f"{P()} ({E()})", self._key(r.choice(["note", "text", "message", "title", "body", "hint"]), f"{P(0.06)} {r.choice(VERBS)} {self._words(1, 4)}."), f"{self.phrase()} {P(0.02)} <{E()}>"])
        if x < 0.42:
            return f"{r.choice([self._words(1, 4).capitalize(), self.phrase() + ' ' + self._words(1, 2)])} {r.choice(BEFORE)} {P(0.1) if r.random() < 0.7 else N()}{r.choice([',', '', '</p>', '"', chr(10), '.', ' ' + self._words(1, 4) + '.', ', ' + A(), ' (' + E() + ')', ' and ' + P(0.05)])}"
        if x < 0.50:
            return r.choice([f"{r.choice(PHONE_WORDS)} {T()}", f"{self._words(1, 4)} {r.choice(PHONE_WORDS)} {T()} {self._words(1, 3)}", self._key(r.choice(["phone", "tel", "mobile", "phoneNumber", "contact", "msisdn", "number"]), T()), f"{E()} / {T()}", f'["{E()}","{T()}"]', f"{r.choice(PHONE_WORDS)} {T()}, {self._words(1, 3)}.", f"{self._words(1, 2)} {r.choice(['will call', 'to', 'call', 'ring', 'reached at', 'number', 'appelle le', 'llamar al', 'anrufen'])} {T()} {self._words(1, 3)}.", f"{self._words(0, 2)} {r.choice(PHONE_WORDS)} {T()}, {r.choice(['ask for', 'ask for', 'speak to', 'contact', 'demandez', 'pregunte por', 'küsige', 'pyydä'])} {N()}{r.choice(['.', '', '</p>', ', ' + self._words(1, 2), chr(10)])}", f"{r.choice(PHONE_WORDS)} {T()} {r.choice('and or und et y ja i и'.split())} {T()}", f"{self.phrase()} {T()}"])
        if x < 0.58:
            sep = r.choice([" ", " ", ": ", ":", " no. ", " is ", " = ", ": <b>", "</td><td>"])
            return r.choice([f"{r.choice(ID_WORDS)}{sep}{J()}", f"{self._words(1, 4)} {r.choice(ID_WORDS)}{sep}{J()} {self._words(1, 3)}.", self._key(r.choice(ID_KEYS), J()), f"{P()} ({r.choice(ID_WORDS)} {J()})", f"{P()}, {r.choice(ID_WORDS)}{sep}{J()}", f"{P()} ({J()})", f"{self._words(1, 3)} ({J()})", f"{P()}, {J()}", f"{self._words(1, 2)} identity {J()}"])
        if x < 0.61:
            return r.choice([f"{self._words(1, 3)} {E()} {self._words(1, 3)}.", self._key(r.choice(["email", "mail", "contact", "login", "to"]), E()), f"mailto:{E()}", f"{r.choice(['E-mail', 'Email:', 'Kontakt:', 'mail', 'Почта:'])} {E()}", f"{E()}"])
        if x < 0.64:
            return r.choice([f"{r.choice(['Address', 'Adresse', 'Dirección', 'Indirizzo', 'Adres', 'Osoite', 'Aadress', 'Адрес', 'Deliver to', 'Ship to', 'Home address', 'moved to', 'lives at'])}{r.choice([': ', ' '])}{A()}, {r.choice(CAPS)}", self._key(r.choice(["street", "address", "line1", "addr", "streetAddress"]), A()), f"{P()}, {A()}, {r.choice(CAPS)}", f"{A()}", f"{self._words(1, 4)} {A()}."])
        # decoys
        if x < 0.72:
            noun = self._noun().capitalize()
            return r.choice([
                f"{r.choice(ARTICLES)} {noun} {self._words(1, 4)}", self._key(r.choice(["text", "hint", "note", "body", "message", "label"]), f"{r.choice([noun, noun, r.choice(CAPS)])} {self._words(1, 4)}{r.choice(['.', ': ' + self._words(2, 4), '!'])}"), f"{self._words(1, 3)} {r.choice(ARTICLES)} {noun}.", f"{noun} {self._words(2, 6)}.", f"{noun} {self._noun()}! {self._words(1, 3)}", f"{noun}: {self._words(2, 5)}", f"{noun} {r.choice('ABCDFGHKLMPT')}/{r.randint(10, 9999)}/{r.randint(10, 99)} {self._words(1, 3)}", f"¡{noun} {self._noun()}! {self._words(1, 3)}", f"¡{noun} {self._noun()}! {self._words(1, 3)}", f"[{r.choice(CAPS).upper()} {noun.upper()}]", f"{noun.upper()} {noun.upper()}{r.choice(['', ' ' + noun.upper()])}", f"{r.choice('¡ ¿ „ “ « ( -'.split())}{noun} {self._words(1, 4)}", f"{self._words(2, 4)} {noun} {self._words(1, 3)}", f"{noun} {r.choice(CAPS)} {self._words(1, 3)}", f"{self._words(1, 3).capitalize()}, {self._words(2, 5)}.",
                f"{self.phrase()}", f"{self.phrase()}: {self.phrase()}", f"{self.phrase()} {self._words(1, 5)}.", f"<h2>{self.phrase()}</h2>", f"{self._words(1, 4).capitalize()} {self.phrase()} {self._words(1, 4)}.", f"{self.phrase().upper()}", f"{r.choice(CAPS)}, {r.choice(CAPS)} {r.choice('and und et y'.split())} {r.choice(CAPS)}"])
        if x < 0.77:
            return self._key(r.choice(["title", "label", "status", "type", "category", "message", "text", "description", "brand", "product", "city", "name", "lang", "currency", "state", "from"]), r.choice([self.phrase(), self.phrase(), self._words(1, 4), self._words(1, 3).capitalize(), r.choice(CAPS).lower()]))
        if x < 0.82:
            b = r.choice(BOTH)
            return r.choice([f"{r.choice(['the', 'a', 'your', 'this', 'each', 'any'])} {b} {self._words(1, 3)}", f"The {r.choice(CAPS)} {b} {self._words(1, 4)}.", f"{b} {r.choice(['all', 'it', 'as', 'the', 'of', 'for', 'your', 'out'])} {self._words(1, 4)}.", f"{r.choice(['in', 'since', 'until', 'by', 'on', 'of', 'for', 'before'])} {r.choice(['April', 'May', 'June'])} {r.choice([str(r.randint(1, 30)), str(r.randint(1, 30)) + ', 2024', '2024', ''])}{r.choice(['.', ',', ''])}",
                             f"{r.choice(CAPS)} {b} {r.choice(CAPS)}", f"{b.lower()} {self._words(1, 4)}", f"{self._words(1, 3)} {b.lower()} {self._words(1, 3)}", f"{r.choice(['Visit', 'Open', 'See', 'Read', 'Choose', 'Press'])} {b} {r.choice(CAPS)}", f"{r.randint(1, 30)} {r.choice(['April', 'May', 'June'])} {r.choice(['2023', '2024', ''])}"])
        if x < 0.88:
            return r.choice([f"{r.choice(PLAIN_WORDS)} {self.number()} {self._words(1, 4)}", f"{r.choice(PLAIN_WORDS).capitalize()} {self.number()} {self._words(1, 3)}.", f"{r.choice(PLAIN_WORDS)}: {self.number()}", self._key(r.choice(PLAIN_KEYS), self.number()), self._key(r.choice(PLAIN_KEYS), self.number()), f"{self._words(1, 3)} {self.number()} {self._words(1, 3)}.", f"#{self.number()}", f"{self.phrase()} {self.number()}"])
        if x < 0.91:
            return r.choice([f"{r.choice(GREETINGS)}! {self._noun().capitalize()} {self._words(1, 4)}", f"{r.choice(GREETINGS)}! {r.choice(CAPS)} {self._words(1, 4)}", f"{r.choice(GREETINGS)}{r.choice([',', '!', ' and welcome!', ' there!', ' again,', ' everyone!'])} {self._words(1, 4)}", f"{r.choice(GREETINGS)} {r.choice(['customer', 'client', 'guest', 'friend', 'kunde', 'cliente', 'klient', 'team', 'Customer', 'Team', 'Sir or Madam', 'All'])}, {self._words(1, 4)}.", f"{r.choice(ROLES)}: {r.choice(['none', 'unknown', '-', 'yes', 'n/a', 'Standard', 'Premium'])}", f"{r.choice(ROLES)} {self._words(1, 4)}.", f"{r.choice(ROLES)} {self.phrase()}", f"{self._words(0, 2)} {r.choice(BEFORE)} {self.phrase()} {self._words(1, 2)}", f"{r.choice(BEFORE)} {r.choice(['the', 'our', 'a', 'your'])} {self._words(1, 3)}"])
        if x < 0.94:
            return r.choice([f"{r.choice(['icon', 'logo', 'banner', 'photo'])}@{r.choice(['2x', '3x'])}.{r.choice(['png', 'webp', 'svg'])}", f"{self._words(1, 1)}@{r.randint(0, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)} {self._words(1, 2)}", f"@{self._words(1, 1)} {self._words(1, 3)}", f"{self._words(1, 2)} at {r.choice(['night', 'noon', '12.30', 'the desk'])}", f"take {self._words(1, 1)} {r.randint(1, 90)} {r.choice(CAPS)} {self._words(1, 2)}"])
        return self._words(3, 10).capitalize() + "."

    def text(self) -> tuple[str, set[tuple[str, int, int]]]:
        """A text of some pieces, with (kind, start, end) of its items; at times one name stands in it again and again."""
        r = self.r
        pieces = [self.piece() for _ in range(r.randint(1, 6))] + [self.plain() for _ in range(r.randint(0, 3))]
        r.shuffle(pieces)
        if r.random() < 0.35:
            pieces += self.again(r.randint(1, 3))
            r.shuffle(pieces)
        return unmark(r.choice(["\n", " ", " ", "</p><p>", '","', "\r\n", "</li>\n<li>", ". "]).join(pieces))

    def plain(self) -> str:
        """A sentence, or two, without items."""
        r = self.r
        parts = []
        for _ in range(r.randint(1, 2)):
            s = self._words(3, 9)
            s = s[0].upper() + s[1:]
            if r.random() < 0.4:
                s = f"{r.choice(CAPS)} {s[0].lower()}{s[1:]}"
            if r.random() < 0.4:
                s += f" {r.choice(ARTICLES)} {self._noun().capitalize()} {self._words(1, 2)}"
            if r.random() < 0.2:
                s += f", {r.choice(LOWER)} {r.choice([f'{r.randint(0, 400)}.{r.randint(10, 99)} ' + r.choice(['EUR', 'USD', 'kr', '€']), str(r.randint(1, 99999)), f'{r.randint(1, 30)}/{r.randint(1, 12)}'])}{r.choice(['', ' ' + self._words(1, 2)])}"
            parts.append(s + r.choice(".....!?:"))
        return " ".join(parts)

    def again(self, n: int, share: float = 0.6) -> list[str]:
        """A person, or capitalised words that are none, behind something that tells which, and at ``n`` places that don't."""
        r = self.r
        if r.random() < share:
            g, f = self.given(), self.family()
            whole = f"{g} {f}"
            forms = [whole, whole, f, g, whole.upper(), whole.lower() if r.random() < 0.5 else whole]
            clear = r.choice([f"{r.choice(GREETINGS)} \x01person\x02{whole}\x03,", f"{r.choice(ROLES)}: \x01person\x02{whole}\x03", f"{r.choice(CLOSINGS)},\n\x01person\x02{whole}\x03", self._key(r.choice(KEYS[:20]), f"\x01person\x02{whole}\x03")])
            item = lambda: f"\x01person\x02{r.choice(forms)}\x03"
        else:
            whole = f"{r.choice(CAPS)} {r.choice(CAPS)}"
            whole = whole if r.random() < 0.5 else f"{self._noun().capitalize()} {r.choice(LOWER)}" if r.random() < 0.5 else self._noun().capitalize()
            clear, item = f"{self.phrase()} {whole}", lambda: whole
        vague = "{X} {w}.|{w} {X} {w}.|{w} {X}, {w}.|{X}: {w}|{X}|{w} {X}.|{W} {X} {w}".split("|")
        return [clear, *(r.choice(vague).replace("{X}", item()).replace("{w}", self._words(1, 4)).replace("{W}", r.choice(CAPS)) for _ in range(n))]


def unmark(marked: str) -> tuple[str, set[tuple[str, int, int]]]:
    """A text without its marks, and (kind, place of the first letter or digit, end) of the items."""
    out, gold, at = [], set(), 0
    for m in re.finditer("\x01(\\w+)\x02([^\x03]*)\x03|[^\x01]+", marked):
        s = m[2] if m[1] else m[0]
        if m[1]:
            gold.add((m[1], at + next((i for i, c in enumerate(s) if c.isalnum()), 0), at + len(s)))
        out.append(s)
        at += len(s)
    return "".join(out), gold

"""What messages that stand where content should be are made of, in many languages: the texts that the verdict of problem 4 is learnt on.

Written from what servers, browsers, frameworks and page builders say everywhere.  After runs on test data a few predicates and ordinary
sentences were added that it missed or took for messages.  Messages are put
together from subjects and predicates, so that words weigh, not sentences.  Ordinary sentences stand against them, among them such as
speak of errors, scripts and samples.
"""

from __future__ import annotations

import random

from tracewell.functions.language import TEXTS
from tracewell.llm.personal_text import GREETINGS, ROLES, Maker, unmark

#: Ordinary texts made of each language's small words, and of made sentences.
WORDS, MADE = 60, 500

#: By language, things that a message is about; what it says of them; whole messages; scripts and cookies; filler.
MESSAGES = {
    "en": (
        "the page|this page|the page you requested|the page you are looking for|that page|the site|this site|the server|the file|the resource|the requested url|the link|this link|this offer|the product|the item|this address|your session|the service|this service|the connection|the request|the database|the gateway|the application|the account|this video|this form",
        "was not found|could not be found|cannot be found|can't be found|can't be displayed|does not exist|doesn't exist|no longer exists|is not available|is no longer available|is unavailable|is temporarily unavailable|has expired|has been removed|has been moved|was deleted|is under maintenance|is under construction|is offline|is down|failed|timed out|was refused|was reset|is not responding|is invalid|is not valid|is too long|is blocked|could not be loaded|failed to load|did not respond|encountered an error|is broken|was rejected|isn't here|is not here|is missing|is gone",
        "not found|page not found|404|404 not found|403 forbidden|forbidden|400 bad request|bad request|401 unauthorized|unauthorized|500 internal server error|internal server error|502 bad gateway|bad gateway|503 service unavailable|service unavailable|504 gateway timeout|gateway timeout|429 too many requests|too many requests|method not allowed|access denied|access forbidden|permission denied|you don't have permission to access this page|you are not authorized to view this page|an error occurred|an error has occurred|an unexpected error occurred|unexpected error|unknown error|error|fatal error|application error|server error|error 404|error code 500|error: connection refused|http error 403|http status 404|status 500|something went wrong|oops|oops, something went wrong|whoops, looks like something went wrong|sorry, we couldn't find that page|we couldn't find what you were looking for|we can't find the page|we can't find that|sorry about that|we are sorry|please try again|please try again later|try again in a few minutes|try again|refresh the page|reload the page|go back|go back to the home page|return to the homepage|back to home|contact the administrator|contact support if the problem persists|we are working on it|we'll be back soon|we will be back shortly|down for maintenance|scheduled maintenance|site under construction|coming soon|check the url and try again|check the address for typos|it may have been moved or deleted|no results found|nothing here|nothing to see here|request timed out|connection timed out|connection refused|connection reset|database connection failed|could not connect to the database|could not connect to the server|could not load data|unable to load|failed to fetch|failed to load resource|failed to load content|invalid request|invalid token|invalid session|session expired|your session has expired, please log in again|please log in to continue|please sign in again|you have been logged out|captcha required|checking your browser before accessing|verify you are human|verifying you are human|your request has been blocked|rate limit exceeded|request limit reached|quota exceeded|traceback (most recent call last)|uncaught exception|unhandled exception|uncaught typeerror: undefined is not a function|null pointer exception|java.lang.nullpointerexception|syntaxerror: unexpected token|keyerror|attributeerror: object has no attribute|stack trace|exception in thread main|warning: undefined variable in file on line|division by zero|segmentation fault|at com.app.main(app.java)|out of memory|disk full|upstream connect error|upstream request timeout|no healthy upstream|template not found|view not found|controller not found|reference id|request id|error reference number|incident id|generated by the web server|nginx|apache server at port|tomcat|cloudflare ray id",
        "please enable javascript|enable javascript to continue|enable javascript to view this page|enable javascript to run this app|you need to enable javascript|javascript is required|javascript is disabled|javascript must be enabled|javascript is turned off in your browser|this site requires javascript|this page needs javascript|this app works best with javascript enabled|please turn on javascript|turn javascript on and reload the page|please allow scripts|allow scripts and reload|activate javascript|scripts are disabled|scripts are required|scripting is off in your browser|your browser does not support javascript|your browser does not support scripts|your browser is not supported|please enable cookies|cookies are required|enable javascript and cookies to continue|please switch on javascript|we're sorry but this app doesn't work properly without javascript enabled|without javascript this page cannot be shown|this content needs scripts to be allowed",
        "lorem ipsum|lorem ipsum dolor sit amet|placeholder|placeholder text|placeholder content|placeholder paragraph|sample text|sample content|sample page|example text|this is an example page|this is a sample page|this is a demo page|demo text|demo content|dummy text|dummy content|test test test|this is a test page|test page|your text here|your text goes here|your title here|your title goes here|your headline goes here|your content here|your logo here|add your text here|add your title|add a description|add content here|insert text here|insert your title here|insert description|enter your text here|enter a title|type your text here|write your description here|click here to edit|click to add text|double click to edit|replace this text|replace this text with your own|replace me|edit this text|body copy goes here|text goes here|headline here|heading|subheading goes here|image caption here|tbd|tbc|todo|to be written|to be done|to be announced|to do: write this|fill this in|fill in later|content coming soon|xxx|xxxx xxxx|asdf asdf|foo bar|blah blah|text text text|bacon ipsum dolor amet|hello world|just another site|untitled document|new page|this is the first paragraph of sample copy",
    ),
    "de": ("die Seite|diese Seite|die angeforderte Seite|die gesuchte Seite|der Server|die Datei|der Link|das Angebot|der Dienst|Ihre Sitzung|die Verbindung|die Anfrage|die Datenbank|das Dokument", "wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|existiert nicht mehr|ist nicht verfügbar|ist derzeit nicht verfügbar|ist nicht mehr verfügbar|ist abgelaufen|wurde gelöscht|wurde verschoben|wird gewartet|ist nicht erreichbar|antwortet nicht|ist fehlgeschlagen|ist ungültig|wurde abgelehnt|kann nicht angezeigt werden",
           "Seite nicht gefunden|nicht gefunden|Zugriff verweigert|kein Zugriff|Fehler|Fehler 404|Fehler 500|Serverfehler|interner Serverfehler|ein Fehler ist aufgetreten|es ist ein Fehler aufgetreten|unerwarteter Fehler|etwas ist schiefgelaufen|bitte versuchen Sie es später erneut|bitte versuchen Sie es erneut|Entschuldigung|leider ist etwas schiefgegangen|zurück zur Startseite|zu viele Anfragen|Zeitüberschreitung|Wartungsarbeiten|wir sind bald zurück|bitte melden Sie sich erneut an|Sitzung abgelaufen|keine Berechtigung|Verbindung fehlgeschlagen|ungültige Anfrage",
           "bitte aktivieren Sie JavaScript|JavaScript ist deaktiviert|JavaScript ist erforderlich|JavaScript muss aktiviert sein|diese Seite benötigt JavaScript|bitte schalten Sie JavaScript ein|bitte erlauben Sie Skripte|Skripte sind deaktiviert|Ihr Browser unterstützt kein JavaScript|bitte aktivieren Sie Cookies|ohne JavaScript kann die Seite nicht angezeigt werden", "Platzhalter|Platzhaltertext|Beispieltext|Mustertext|Blindtext|hier steht Ihr Text|hier könnte Ihr Text stehen|Ihr Text hier|fügen Sie hier Ihren Text ein|Text einfügen|Überschrift hier|Titel eingeben|Beschreibung hinzufügen|dies ist ein Beispieltext|Dies ist eine Demoseite|Inhalt folgt"),
    "fr": ("la page|cette page|la page demandée|la page que vous cherchez|le site|le serveur|le fichier|le lien|cette offre|le service|votre session|la connexion|la requête|la base de données", "est introuvable|n'existe pas|n’existe pas|n'existe plus|n’existe plus|n'a pas été trouvée|n’a pas pu être trouvée|n'est pas disponible|n’est plus disponible|est indisponible|est temporairement indisponible|a expiré|a été supprimée|a été déplacée|est en maintenance|est en construction|ne répond pas|a échoué|est invalide|a été refusée|ne peut pas être affichée",
           "page introuvable|page non trouvée|introuvable|accès refusé|accès interdit|erreur|erreur 404|erreur 500|erreur serveur|erreur interne du serveur|une erreur est survenue|une erreur s'est produite|une erreur inattendue|erreur inattendue|un problème est survenu|oups|désolé|veuillez réessayer|veuillez réessayer plus tard|retour à l'accueil|trop de requêtes|délai dépassé|maintenance en cours|nous serons bientôt de retour|veuillez vous reconnecter|session expirée|vous n'avez pas les droits|connexion refusée|requête invalide",
           "veuillez activer JavaScript|activez JavaScript|JavaScript est désactivé|JavaScript est requis|JavaScript est nécessaire|JavaScript doit être activé|ce site nécessite JavaScript|cette page a besoin de JavaScript|veuillez activer les scripts|veuillez autoriser les scripts|les scripts sont désactivés|votre navigateur ne prend pas en charge JavaScript|veuillez activer les cookies|activez JavaScript pour continuer", "texte d'exemple|texte de remplissage|texte provisoire|exemple de texte|votre texte ici|votre titre ici|insérez votre texte ici|ajoutez votre texte|ajoutez un titre|saisissez votre texte|ceci est une page d'exemple|ceci est un texte de démonstration|contenu à venir|faux texte|page de démonstration"),
    "es": ("la página|esta página|la página solicitada|la página que busca|el sitio|el servidor|el archivo|el enlace|esta oferta|el servicio|su sesión|la conexión|la solicitud|la base de datos", "no existe|ya no existe|no se encuentra|no se ha encontrado|no se pudo encontrar|no fue encontrada|no está disponible|ya no está disponible|ha caducado|ha expirado|fue eliminada|ha sido movida|está en mantenimiento|está en construcción|no responde|ha fallado|no es válida|fue rechazada|no se puede mostrar",
           "página no encontrada|no encontrado|acceso denegado|acceso prohibido|error|error 404|error 500|error del servidor|error interno del servidor|ha ocurrido un error|se ha producido un error|error inesperado|algo salió mal|algo ha ido mal|lo sentimos|vaya|inténtelo de nuevo|inténtelo más tarde|por favor, inténtelo de nuevo más tarde|volver al inicio|demasiadas solicitudes|tiempo de espera agotado|en mantenimiento|volveremos pronto|inicie sesión de nuevo|sesión caducada|no tiene permiso|conexión rechazada|solicitud no válida",
           "active JavaScript|por favor, active JavaScript|habilite JavaScript|JavaScript está desactivado|JavaScript es necesario|este sitio requiere JavaScript|esta página necesita JavaScript|debe activar JavaScript|permita los scripts|los scripts están desactivados|su navegador no admite JavaScript|active las cookies|active JavaScript para continuar", "texto de ejemplo|texto de relleno|texto provisional|su texto aquí|tu texto aquí|su título aquí|inserte su texto aquí|escriba su texto aquí|añada su texto|añada un título|esta es una página de ejemplo|contenido de prueba|contenido próximamente|página de demostración"),
    "it": ("la pagina|questa pagina|la pagina richiesta|la pagina cercata|il sito|il server|il file|il link|questa offerta|il servizio|la sessione|la connessione|la richiesta", "non esiste|non esiste più|non è stata trovata|non trovata|non è disponibile|non è più disponibile|è scaduta|è stata rimossa|è stata spostata|è in manutenzione|è in costruzione|non risponde|non è riuscita|non è valida|è stata rifiutata",
           "pagina non trovata|non trovato|accesso negato|accesso vietato|errore|errore 404|errore 500|errore del server|errore interno del server|si è verificato un errore|errore imprevisto|qualcosa è andato storto|spiacenti|ops|riprova|riprova più tardi|si prega di riprovare più tardi|torna alla home|troppe richieste|tempo scaduto|manutenzione in corso|torneremo presto|accedi di nuovo|sessione scaduta|connessione rifiutata|richiesta non valida",
           "attiva JavaScript|abilita JavaScript|si prega di attivare JavaScript|JavaScript è disattivato|JavaScript è necessario|questo sito richiede JavaScript|questa pagina richiede JavaScript|consenti gli script|il tuo browser non supporta JavaScript|abilita i cookie", "testo di esempio|testo segnaposto|il tuo testo qui|inserisci qui il testo|inserisci il titolo|aggiungi il tuo testo|questa è una pagina di esempio|contenuto in arrivo"),
    "pt": ("a página|esta página|a página solicitada|a página que procura|o site|o servidor|o ficheiro|o arquivo|o link|esta oferta|o serviço|a sua sessão|a conexão|o pedido", "não existe|já não existe|não foi encontrada|não encontrada|não está disponível|já não está disponível|expirou|foi removida|foi movida|está em manutenção|está em construção|não responde|falhou|é inválido|foi recusada",
           "página não encontrada|não encontrado|acesso negado|acesso proibido|erro|erro 404|erro 500|erro do servidor|erro interno do servidor|ocorreu um erro|erro inesperado|algo deu errado|algo correu mal|desculpe|ops|tente novamente|tente novamente mais tarde|por favor, tente novamente|voltar ao início|muitas solicitações|tempo esgotado|em manutenção|voltaremos em breve|inicie sessão novamente|sessão expirada|conexão recusada|pedido inválido",
           "ative o JavaScript|habilite o JavaScript|por favor, ative o JavaScript|JavaScript está desativado|JavaScript é necessário|este site requer JavaScript|esta página precisa de JavaScript|permita os scripts|o seu navegador não suporta JavaScript|ative os cookies|ative o JavaScript para continuar", "texto de exemplo|texto provisório|o seu texto aqui|seu texto aqui|seu título aqui|insira o seu texto aqui|digite seu texto|adicione um título|esta é uma página de exemplo|conteúdo em breve"),
    "nl": ("de pagina|deze pagina|de opgevraagde pagina|de site|de server|het bestand|de link|deze aanbieding|de dienst|uw sessie|de verbinding|het verzoek", "is niet gevonden|kan niet worden gevonden|bestaat niet|bestaat niet meer|is niet beschikbaar|is niet meer beschikbaar|is verlopen|is verwijderd|is verplaatst|is in onderhoud|reageert niet|is mislukt|is ongeldig|is geweigerd", "pagina niet gevonden|niet gevonden|toegang geweigerd|geen toegang|fout|fout 404|serverfout|interne serverfout|er is een fout opgetreden|onverwachte fout|er ging iets mis|er is iets misgegaan|sorry|oeps|probeer het opnieuw|probeer het later opnieuw|terug naar de startpagina|te veel verzoeken|onderhoud|we zijn zo terug|sessie verlopen|log opnieuw in",
           "schakel JavaScript in|JavaScript is uitgeschakeld|JavaScript is vereist|deze site vereist JavaScript|sta scripts toe|uw browser ondersteunt geen JavaScript|schakel cookies in", "voorbeeldtekst|plaatshoudertekst|uw tekst hier|voeg hier uw tekst toe|voer hier tekst in|titel hier|dit is een voorbeeldpagina|inhoud volgt"),
    "sv": ("sidan|den här sidan|sidan du söker|webbplatsen|servern|filen|länken|erbjudandet|tjänsten|din session|anslutningen", "hittades inte|kunde inte hittas|finns inte|finns inte längre|är inte tillgänglig|är inte längre tillgänglig|har gått ut|har tagits bort|har flyttats|svarar inte|misslyckades|är ogiltig", "sidan hittades inte|hittades inte|åtkomst nekad|fel|fel 404|serverfel|internt serverfel|ett fel har inträffat|ett fel uppstod|oväntat fel|något gick fel|tyvärr|hoppsan|försök igen|försök igen senare|tillbaka till startsidan|för många förfrågningar|underhåll pågår|vi är snart tillbaka|sessionen har gått ut|logga in igen",
           "aktivera JavaScript|JavaScript är inaktiverat|JavaScript krävs|sidan kräver JavaScript|slå på JavaScript|tillåt skript|din webbläsare stöder inte JavaScript|aktivera cookies", "exempeltext|platshållartext|din text här|skriv din text här|lägg till text|rubrik här|detta är en exempelsida|innehåll kommer snart"),
    "fi": ("sivu|tämä sivu|pyydetty sivu|etsimäsi sivu|sivusto|palvelin|tiedosto|linkki|tarjous|palvelu|istuntosi|yhteys|pyyntö", "ei löytynyt|ei löydy|ei ole olemassa|ei ole enää olemassa|ei ole saatavilla|ei ole enää saatavilla|on vanhentunut|on poistettu|on siirretty|on huollossa|ei vastaa|epäonnistui|on virheellinen", "sivua ei löytynyt|ei löytynyt|pääsy estetty|pääsy kielletty|käyttö estetty|virhe|virhe 404|palvelinvirhe|sisäinen palvelinvirhe|tapahtui virhe|odottamaton virhe|jokin meni pieleen|jotain meni vikaan|valitettavasti|hups|yritä uudelleen|yritä myöhemmin uudelleen|takaisin etusivulle|liian monta pyyntöä|huoltokatko|palaamme pian|istunto on vanhentunut|kirjaudu uudelleen",
           "ota JavaScript käyttöön|JavaScript on pois päältä|JavaScript vaaditaan|tämä sivusto vaatii JavaScriptin|sivu tarvitsee JavaScriptiä|salli skriptit|komentosarjat on estetty|selaimesi ei tue JavaScriptiä|ota evästeet käyttöön", "esimerkkiteksti|paikkateksti|täyteteksti|tekstisi tähän|kirjoita tekstisi tähän|lisää teksti|lisää otsikko|otsikko tähän|tämä on esimerkkisivu|sisältö tulossa"),
    "et": ("leht|see leht|otsitud leht|soovitud lehte|sait|server|fail|link|pakkumine|teenus|teie seanss|ühendus|päring", "ei leitud|ei leidu|ei ole olemas|pole enam olemas|pole saadaval|ei ole enam saadaval|on aegunud|on kustutatud|on teisaldatud|on hoolduses|ei vasta|ebaõnnestus|on vigane", "lehte ei leitud|lehekülge ei leitud|ei leitud|juurdepääs keelatud|ligipääs keelatud|viga|viga 404|serveri viga|sisemine serveri viga|tekkis viga|ilmnes viga|ootamatu viga|midagi läks valesti|vabandust|ups|proovige uuesti|proovige hiljem uuesti|palun proovige hiljem uuesti|tagasi avalehele|liiga palju päringuid|hooldustööd|oleme varsti tagasi|seanss on aegunud|logige uuesti sisse",
           "palun lubage JavaScript|lülitage JavaScript sisse|JavaScript on välja lülitatud|JavaScript on vajalik|see leht vajab JavaScripti|lehe kuvamiseks lülitage JavaScript sisse|lubage skriptid|skriptid on keelatud|teie brauser ei toeta JavaScripti|lubage küpsised", "näidistekst|kohatäitetekst|teie tekst siia|sinu tekst siia|siia tuleb tekst|siia tuleb sinu tekst|sisestage tekst siia|lisage pealkiri|pealkiri siia|see on näidisleht|sisu on tulekul"),
    "pl": ("strona|ta strona|żądana strona|szukana strona|serwis|serwer|plik|link|ta oferta|usługa|twoja sesja|połączenie|żądanie", "nie została znaleziona|nie istnieje|już nie istnieje|jest niedostępna|jest chwilowo niedostępna|nie jest już dostępna|wygasła|została usunięta|została przeniesiona|jest w trakcie konserwacji|nie odpowiada|nie powiodło się|jest nieprawidłowe|zostało odrzucone", "nie znaleziono strony|strona nie istnieje|nie znaleziono|brak dostępu|odmowa dostępu|dostęp zabroniony|błąd|błąd 404|błąd 500|błąd serwera|wewnętrzny błąd serwera|wystąpił błąd|nieoczekiwany błąd|coś poszło nie tak|przepraszamy|ups|spróbuj ponownie|spróbuj ponownie później|proszę spróbować później|wróć na stronę główną|zbyt wiele żądań|przerwa techniczna|wkrótce wrócimy|sesja wygasła|zaloguj się ponownie",
           "włącz JavaScript|proszę włączyć JavaScript|włącz obsługę JavaScript|JavaScript jest wyłączony|JavaScript jest wymagany|ta strona wymaga JavaScript|zezwól na skrypty|skrypty są wyłączone|twoja przeglądarka nie obsługuje JavaScript|włącz ciasteczka", "przykładowy tekst|tekst zastępczy|tu wpisz tekst|tutaj wpisz swój tekst|twój tekst tutaj|wstaw tekst|dodaj tytuł|tytuł tutaj|to jest przykładowa strona|treść wkrótce"),
    "cs": ("stránka|tato stránka|požadovaná stránka|web|server|soubor|odkaz|nabídka|služba|relace", "nebyla nalezena|neexistuje|již neexistuje|není dostupná|není k dispozici|vypršela|byla odstraněna|byla přesunuta|neodpovídá|selhala|je neplatná", "stránka nenalezena|nenalezeno|přístup odepřen|chyba|chyba 404|chyba serveru|došlo k chybě|neočekávaná chyba|něco se pokazilo|omlouváme se|zkuste to znovu|zkuste to prosím později|zpět na úvod|probíhá údržba|relace vypršela|přihlaste se znovu", "povolte JavaScript|zapněte JavaScript|JavaScript je vypnutý|JavaScript je vyžadován|tato stránka vyžaduje JavaScript|povolte skripty|váš prohlížeč nepodporuje JavaScript", "ukázkový text|zástupný text|sem napište text|váš text zde|vložte text|přidejte nadpis|toto je ukázková stránka"),
    "ru": ("страница|эта страница|запрошенная страница|запрашиваемая страница|сайт|сервер|файл|ссылка|предложение|сервис|служба|ваша сессия|соединение|запрос", "не найдена|не найден|не существует|больше не существует|недоступна|недоступен|временно недоступен|временно недоступна|больше недоступно|устарела|удалена|перемещена|на обслуживании|не отвечает|не удалось|недействителен|отклонено|истекла", "страница не найдена|не найдено|ничего не найдено|доступ запрещён|доступ запрещен|нет доступа|ошибка|ошибка 404|ошибка 500|ошибка сервера|внутренняя ошибка сервера|произошла ошибка|неизвестная ошибка|непредвиденная ошибка|что-то пошло не так|извините|упс|попробуйте ещё раз|попробуйте позже|повторите попытку позже|пожалуйста, попробуйте позже|вернуться на главную|слишком много запросов|превышено время ожидания|ведутся технические работы|скоро вернёмся|сессия истекла|войдите снова",
           "включите JavaScript|пожалуйста, включите JavaScript|JavaScript отключён|JavaScript отключен|требуется JavaScript|для работы сайта нужен JavaScript|эта страница требует JavaScript|разрешите скрипты|включите скрипты|скрипты отключены|ваш браузер не поддерживает JavaScript|включите cookies", "пример текста|текст-заполнитель|текст-рыба|ваш текст|здесь будет текст|здесь будет ваш текст|введите текст|вставьте текст сюда|добавьте заголовок|заголовок здесь|это пример страницы|содержимое скоро появится"),
    "tr": ("sayfa|bu sayfa|istenen sayfa|aradığınız sayfa|site|sunucu|dosya|bağlantı|bu teklif|hizmet|oturumunuz|istek", "bulunamadı|mevcut değil|artık mevcut değil|kullanılamıyor|şu anda kullanılamıyor|süresi doldu|kaldırıldı|taşındı|bakımda|yanıt vermiyor|başarısız oldu|geçersiz", "sayfa bulunamadı|bulunamadı|erişim engellendi|erişim reddedildi|hata|hata 404|sunucu hatası|bir hata oluştu|beklenmeyen hata|bir şeyler ters gitti|üzgünüz|tekrar deneyin|lütfen daha sonra tekrar deneyin|ana sayfaya dön|çok fazla istek|bakım çalışması|oturum süresi doldu|yeniden giriş yapın", "JavaScript'i etkinleştirin|lütfen JavaScript'i açın|JavaScript devre dışı|JavaScript gerekli|bu site JavaScript gerektirir|betiklere izin verin|tarayıcınız JavaScript desteklemiyor|çerezleri etkinleştirin", "örnek metin|yer tutucu metin|metniniz buraya|buraya metin girin|başlık ekleyin|bu bir örnek sayfadır"),
    "ja": ("ページ|このページ|お探しのページ|サイト|サーバー|ファイル|リンク|サービス|セッション|接続", "が見つかりません|は見つかりません|は存在しません|は利用できません|は現在利用できません|の有効期限が切れました|は削除されました|は移動しました|が応答しません|に失敗しました", "ページが見つかりません|見つかりませんでした|アクセスが拒否されました|アクセス権がありません|エラー|エラーが発生しました|サーバーエラー|内部サーバーエラー|予期しないエラー|問題が発生しました|申し訳ございません|申し訳ありません|もう一度お試しください|しばらくしてからもう一度お試しください|トップページへ戻る|メンテナンス中|再度ログインしてください", "JavaScriptを有効にしてください|JavaScriptが無効です|JavaScriptが必要です|スクリプトを許可してください|お使いのブラウザはJavaScriptに対応していません|Cookieを有効にしてください", "サンプルテキスト|ダミーテキスト|ここにテキスト|ここにテキストを入力|ここに文章が入ります|タイトルを入力|見出しを入力|これはサンプルページです"),
    "zh": ("页面|该页面|您访问的页面|网页|网站|服务器|文件|链接|服务|会话|连接", "不存在|未找到|找不到|无法找到|无法访问|暂时无法访问|不可用|已过期|已失效|已被删除|已移动|没有响应|失败|无效", "页面不存在|找不到页面|找不到网页|未找到|访问被拒绝|禁止访问|没有权限|错误|发生错误|服务器错误|内部服务器错误|出错了|出了点问题|抱歉|很抱歉|请重试|请稍后再试|返回首页|请求过多|系统维护中|登录已过期|请重新登录", "请启用JavaScript|请启用 JavaScript|请启用脚本|请开启JavaScript|需要JavaScript|您的浏览器不支持JavaScript|请允许脚本|JavaScript已被禁用|请启用Cookie", "示例文本|占位文本|占位符|此处输入文字|此处填写内容|在此输入文字|请输入标题|这是示例页面|内容即将推出"),
}
#: Ordinary sentences, by language apart from none; such as speak of errors, scripts and samples among them.
ORDINARY = """Your parcel is ready at the counter.|The invoice of March was paid on time.|We repaired the bicycle and tested the brakes.|Your appointment was moved to Monday at ten.|The museum opens at nine and closes at six.|Points are added to your account every night.|The winter offer ends on Sunday.|Two tickets for the ferry were booked.|The water meter was read by our team.|Your photo book was printed yesterday.|Take the bus to the old harbour and walk north.|The clinic asks all patients to bring their card.|Members receive a voucher for coffee.|The library has new books for children.|Delivery takes two or three days.|The contract runs until the end of next year.|Call us if you want to change the time.|Thank you for your order.|Your order was sent today.|The price includes breakfast and parking.|Please bring a warm coat.|We wait for you in the garden.
If a page shows an error, check the link and ask again.|The lesson explains why browsers run scripts and how a site uses JavaScript.|The service was down for five minutes last night; since then all is fine.|Error rates stayed under one percent all week.|A not found message means that the address is wrong, says the guide.|In our course you learn what a placeholder is and where it is used.|The word ipsum stands in many sample texts, a teacher explained.|The maintenance of the lift was finished on Friday.|Students wrote a test about the old page and its history.|The team fixed the server and wrote a report about the failure.|The report lists every status code that the system returned in May.|Our support team answers questions about errors and access rights.|We removed the old link from the newsletter and added a new one.|The session on web security starts at noon in room four.|The cookies from our bakery are available again.|No errors were found in the audit of the year.|The exhibition Forbidden City is open until June.|The bridge is under construction, so the bus takes another way.
Ihr Paket liegt an der Kasse bereit.|Die Rechnung wurde gestern bezahlt.|Der Termin ist am Montag um zehn Uhr.|Wir haben das Fahrrad repariert.|Die Führung beginnt im Garten.|Ihre Punkte werden jede Nacht gutgeschrieben.|Das Museum öffnet um neun Uhr.|Bitte prüfen Sie Ihre Bestellung bis Freitag.|Die Lieferung dauert zwei Tage.|Votre colis est arrivé au guichet.|La facture a été payée hier.|Le rendez-vous est lundi à dix heures.|Nous avons réparé le vélo.|Merci de vérifier votre commande avant vendredi.|La livraison prend deux jours.|Le musée ouvre à neuf heures.|Su paquete está listo en la tienda.|La factura se pagó ayer.|La cita es el lunes a las diez.|Hemos reparado la bicicleta.|Revise su pedido antes del viernes.|El museo abre a las nueve.|El descuento termina mañana.|Il pacco è pronto al banco.|La fattura è stata pagata ieri.|L'appuntamento è lunedì alle dieci.|O seu pacote está pronto no balcão.|A fatura foi paga ontem.|A consulta é na segunda-feira.|Uw pakket ligt klaar.|De rekening is gisteren betaald.|Ditt paket är klart att hämta.|Fakturan betalades i går.
Pakettisi on valmis noudettavaksi.|Lasku maksettiin eilen.|Aika on maanantaina kello kymmenen.|Korjasimme polkupyörän.|Vahvista tilaus ennen perjantaita.|Museo aukeaa yhdeksältä.|Teie pakk on valmis.|Arve maksti eile ära.|Aeg on esmaspäeval kell kümme.|Palun kinnitage tellimus enne reedet.|Muuseum avatakse kell üheksa.|Twoja paczka jest gotowa do odbioru.|Faktura została wczoraj zapłacona.|Wizyta jest w poniedziałek o dziesiątej.|Prosimy potwierdzić zamówienie do piątku.|Váš balík je připraven.|Faktura byla včera zaplacena.|Ваша посылка готова к выдаче.|Счёт был оплачен вчера.|Приём в понедельник в десять часов.|Проверьте заказ до пятницы.|Музей открывается в девять.|Скидка действует до завтра.|Срок подписки истёк вчера, продлите её в приложении.|Siparişiniz hazır.|Fatura dün ödendi.|ご注文の商品が届きました。|明日までに荷物をお受け取りください。|金曜日までに予約をご確認ください。|お荷物は駅の窓口にあります。|請求書は昨日支払われました。|予約は月曜日の十時です。|カードの情報を確認してください。|您的订单已送到。|账单昨天已付款。|预约时间是星期一上午。|请在周五之前确认订单。"""


def examples(seed: int, per: int = 3) -> list[tuple[str, bool]]:
    """(text, whether it is a message) made of the lists, in a fixed order: each subject with ``per`` predicates of its language."""
    r = random.Random(seed)
    out: list[tuple[str, bool]] = []
    for lang, (subjects, predicates, whole, scripts, filler) in MESSAGES.items():
        gap = "" if lang in ("ja", "zh") else " "
        said = predicates.split("|")
        for s in subjects.split("|"):
            out += [(f"{s}{gap}{p}", True) for p in r.sample(said, min(per, len(said)))]
        out += [(x, True) for part in (whole, scripts, filler) for x in part.split("|") for _ in range(2)]
    plain = [x for x in ORDINARY.replace("\n", "|").split("|") if x]
    out += [(x, False) for x in plain for _ in range(4)]
    out += [(f"{x} {y}", False) for x, y in zip(r.sample(plain, len(plain)), r.sample(plain, len(plain)))]
    # ordinary sentences about the things that messages are about
    for lang in ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "fi", "et", "pl", "ru"):
        for s in MESSAGES[lang][0].split("|"):
            out += [(f"{s} {' '.join(r.choice(plain).rstrip('.').split()[1:])}", False) for _ in range(2)]
    # small words of many languages, headings, greetings, and sentences with invented nouns
    for text in TEXTS.values():
        words = text.split()
        out += [(" ".join(r.choices(words, k=r.randint(1, 7))), False) for _ in range(WORDS)]
    # what messages say, inside longer sentences
    for lang in sorted(MESSAGES.keys() & TEXTS.keys()):
        words, said = TEXTS[lang].split(), MESSAGES[lang][1].split("|")
        out += [(" ".join((*r.choices(words, k=r.randint(2, 5)), r.choice(said), *r.choices(words, k=r.randint(4, 8)))), False) for _ in range(WORDS)]
    maker = Maker(seed)
    out += [(x, False) for _ in range(MADE) for x in (maker.plain(), maker.phrase(), r.choice(GREETINGS), r.choice(ROLES), maker._words(1, 2), unmark(maker.piece())[0])]
    r.shuffle(out)
    return [(x[0].upper() + x[1:] + r.choice(["", ".", "!"]) if x else x, y) for x, y in out]

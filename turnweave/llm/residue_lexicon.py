"""Words and phrases of residue in English, German, French and Spanish. All are fixed values, in natural spelling; they
are folded (case, accents, digits) when they are read. They state what such pages are about, not the wording of any
table: telling phrases, web objects, faults, demands, advice and the vocabulary around them."""

from __future__ import annotations

#: Phrases that real content doesn't consist of. A 9 stands for any digit, and for a number at the end of a phrase.
STRONG = frozenset((
    # errors of servers and networks
    "999 not found", "not found 999", "error 9", "error #9", "error: 9", "error code", "http 9", "status 9", "status code", "(code 9", "code: 9", "999 gone", "internal server error", "server error", "bad gateway",
    "service unavailable", "gateway timeout", "gateway time-out", "request timeout", "request timed out", "too many requests", "bad request", "method not allowed", "access denied", "access is denied", "permission denied",
    "unauthorized", "forbidden", "page not found", "file not found", "resource not found", "resource not available", "removed by its owner", "page you requested", "page you are looking for", "page you're looking for", "page you were looking for",
    "you requested has been removed", "you're looking for", "you are looking for", "you were looking for", "may have been moved", "may have been deleted", "may have been removed", "may have been renamed", "you requested could not", "could not be found on this server", "don't have permission to", "do not have permission to", "you are not authorized", "something went wrong",
    "an unexpected error", "an error has occurred", "an error occurred", "error has occurred", "that didn't work", "failed to fetch", "failed to load", "failed to open stream", "connection reset", "connection refused", "connection timed out", "connection was interrupted",
    "connection is not private", "could not connect to", "couldn't connect to", "unable to connect to", "unable to establish", "took too long to respond", "site can't be reached", "server not found", "dns address", "dns_probe", "err_connection", "err_name",
    "temporarily unavailable", "currently unavailable", "down for maintenance", "under maintenance", "scheduled maintenance", "will be back shortly", "be right back", "session has expired", "session expired", "session timed out", "been logged out", "been signed out",
    "link has expired", "log in again", "sign in again", "please log in", "please sign in", "sent too many", "please try again later", "please try again", "retry after 9", "rate limit", "quota exceeded", "you are offline", "no internet connection",
    "traceback (most recent call last)", "stack trace", "unhandled exception", "uncaught exception", "uncaught typeerror", "exception in thread", "fatal error", "parse error", "syntax error", "null pointer", "nullpointerexception", "runtimeerror", "importerror", "modulenotfounderror",
    "indexerror", "keyerror", "valueerror", "typeerror", "attributeerror", "referenceerror", "syntaxerror", "segmentation fault", "core dumped", "out of memory", "undefined index", "undefined variable", "memory size", "bytes exhausted", "java.lang", ".java:9", ".js:9", ".php:9", ".php on line 9", ".py\", line 9", ", line 9, in", "in <module>", "sqlstate", "deadlock", "could not connect to the database",
    "request id", "reference no", "reference #", "reference id", "incident", "incident id", "trace id", "correlation id", "ray id", "verify you are human", "verify your browser", "site connection is secure", "don't have access to", "do not have access to", "verify that you are human", "you are not a robot", "you're not a robot", "are you a robot", "checking your browser", "unusual traffic", "complete the captcha", "completing the check below", "solve the captcha", "security check", "sicherheitsüberprüfung", "vérification de sécurité", "control de seguridad",
    "you will be redirected", "you are being redirected", "have been blocked", "account has been suspended", "domain is parked", '"error"', '"status"', "proceeding to the site", "index of /", "may take a few seconds",
    # notices
    "requires javascript", "enable javascript", "javascript is disabled", "javascript is required", "javascript to run", "turn on javascript", "noscript", "without javascript", "enable cookies", "cookies are disabled", "accept cookies", "accept all cookies", "we use cookies", "uses cookies", "use of cookies",
    "cookie settings", "cookie policy", "cookie preferences", "manage cookies", "browser is not supported", "browser isn't supported", "unsupported browser", "outdated browser", "browser is out of date", "browser does not support", "browser doesn't support", "update your browser", "upgrade your browser",
    "browser is too old", "modern browser", "supported browser", "ad blocker", "adblocker", "turn it on and reload", "some features of the",
    # filler and stubs
    "lorem ipsum", "coming soon", "is a placeholder", "placeholder text", "will be filled later", "your text here", "text here", "text goes here", "content goes here", "goes here", "replace this paragraph", "replace this text", "replace with your own", "with your own transcript", "with your own text", "sample dialogue", "sample text", "dummy text",
    "speaker one says something", "speaker two says something", "intentionally left blank", "click to edit", "click here to edit", "add your text", "insert text", "type your text", "to be announced", "to be determined", "to be added", "to be written", "content to follow", "more to come", "no content yet", "nothing here yet", "nothing to see here yet", "just another site", "description goes here",
    # German
    "es ist ein fehler aufgetreten", "ein fehler ist aufgetreten", "fehler aufgetreten", "fehler ist aufgetreten", "fehler 9", "fehlercode", "vorgang 9", "vorgangsnummer", "referenznummer", "interner serverfehler", "serverfehler", "versuchen sie es später", "versuchen sie es erneut", "versuchen sie es noch einmal", "wurde nicht gefunden", "konnte nicht gefunden", "nicht gefunden werden", "seite nicht gefunden", "datei nicht gefunden",
    "momentan nicht verfügbar", "wegen wartung geschlossen", "wartungsarbeiten", "sitzung abgelaufen", "melden sie sich erneut an", "bitte melden sie sich an", "zugriff verweigert", "kein zugriff", "keine berechtigung", "zeitüberschreitung", "verbindung zum server", "verbindung wurde unterbrochen", "ungültige anfrage", "zu viele anfragen", "etwas ist schiefgelaufen", "schiefgelaufen", "schiefgegangen",
    "bestätigen sie, dass sie ein mensch", "kein roboter", "sie werden weitergeleitet",
    "javascript aktivieren", "aktivieren sie javascript", "javascript ist deaktiviert", "benötigt javascript", "ohne javascript", "lässt keine skripte zu", "einschalten und neu laden", "cookies und skripte", "verwendet cookies", "verwenden cookies", "nutzt cookies", "nutzen cookies", "cookies zulassen", "cookies akzeptieren", "alle cookies", "cookies sind deaktiviert", "cookie-einstellungen", "kann das gespräch nicht angezeigt werden", "browser wird nicht unterstützt", "browser unterstützt", "browser ist veraltet", "veralteten browser", "aktualisieren sie ihren browser", "werbeblocker",
    "blindtext", "hier steht später", "hier entsteht", "in kürze verfügbar", "demnächst verfügbar", "der echte text", "inhalt folgt", "text folgt", "inhalte folgen", "nur ein platzhalter", "dies ist ein platzhalter", "platzhaltertext", "beispieltext", "mustertext", "hier bitte das gespräch einfügen", "hier text einfügen", "text hier einfügen", "ihr text hier", "hier klicken, um",
    # French
    "une erreur interne", "erreur interne", "erreur 9", "code d'erreur", "numéro d'incident", "erreur est survenue", "une erreur s'est produite", "erreur s'est produite", "page introuvable", "fichier introuvable", "momentanément indisponible", "temporairement indisponible", "actuellement indisponible", "réessayez dans", "réessayez plus tard", "réessayer plus tard", "veuillez réessayer",
    "session a expiré", "session expirée", "lien a expiré", "reconnectez-vous", "veuillez vous connecter", "vous reconnecter", "accès refusé", "accès interdit", "accès non autorisé", "pas autorisé à", "délai d'attente", "trop de requêtes", "requête incorrecte", "impossible de se connecter", "connexion au serveur", "quelque chose s'est mal passé", "n'êtes pas un robot", "vous êtes humain", "allez être redirigé",
    "activer javascript", "activez javascript", "javascript est désactivé", "besoin de javascript", "nécessite javascript", "sans javascript", "cookies doivent être", "utilise des cookies", "utilisons des cookies", "accepter les cookies", "accepter tous les cookies", "acceptez les cookies", "cookies sont désactivés", "bloque les scripts", "activez-les pour continuer", "navigateur n'est pas pris en charge", "navigateur n'est pas compatible", "navigateur est obsolète", "navigateur obsolète", "navigateur ne prend pas en charge", "mettez à jour votre navigateur", "bloqueur de publicité",
    "contenu à venir", "bientôt disponible", "prochainement", "sera complétée plus tard", "votre texte ici", "insérez votre texte", "saisissez votre texte", "texte d'exemple", "texte fictif", "faux texte", "insérez le dialogue ici", "texte de remplissage", "texte à remplacer", "page provisoire", "contenu provisoire", "texte provisoire",
    # Spanish
    "error interno del servidor", "error interno", "error del servidor", "error 9", "código 9", "código de error", "incidencia 9", "ha ocurrido un error", "se ha producido un error", "se produjo un error", "ocurrió un error", "inténtelo más tarde", "inténtelo de nuevo", "intente más tarde", "intente nuevamente", "inténtalo de nuevo", "inténtalo más tarde", "vuelva a intentarlo", "vuelve a intentarlo", "no se puede acceder", "vuelva en 9",
    "sesión ha caducado", "sesión ha expirado", "sesión caducada", "enlace ha caducado", "vuelva a entrar", "inicie sesión", "iniciar sesión de nuevo", "acceso denegado", "acceso prohibido", "no tiene permiso", "no está autorizado", "demasiadas solicitudes", "solicitud incorrecta", "tiempo de espera", "no se pudo conectar", "conexión con el servidor", "algo salió mal", "algo ha salido mal", "no eres un robot", "no es un robot", "que es humano", "será redirigido",
    "active javascript", "activar javascript", "habilite javascript", "habilitar javascript", "javascript está desactivado", "requiere javascript", "sin javascript", "necesita que los scripts", "utiliza cookies", "usa cookies", "utilizamos cookies", "usamos cookies", "aceptar cookies", "aceptar las cookies", "aceptar todas las cookies", "acepte las cookies", "cookies están desactivadas", "navegador no admite", "navegador no es compatible", "navegador no compatible", "navegador está desactualizado", "navegador obsoleto", "actualice su navegador", "actualiza tu navegador", "no se puede mostrar", "bloqueador de anuncios",
    "contenido próximamente", "próximamente", "página es provisional", "página provisional", "texto provisional", "escribe aquí tu texto", "escriba aquí su texto", "su texto aquí", "tu texto aquí", "inserte su texto", "texto aquí", "solo de relleno", "texto de ejemplo", "texto de muestra", "texto de prueba", "inserte aquí el diálogo", "texto de relleno", "texto simulado",
))

#: What a fault can be said of.
OBJECTS = frozenset(
    "page pages site sites website webpage web server servers url uri link hyperlink address host domain dns file files document resource record recording recordings clip audio video transcript transcription session connection network internet database request login account service application app player viewer loader module content query proxy certificate dialogue transcription "
    "seite webseite website anmeldung gespräch dialog transkription server datei dokument aufnahme sitzung verbindung netzwerk datenbank anfrage konto dienst anwendung adresse ressource transkript "
    "site page dialogue serveur fichier document ressource enregistrement session connexion réseau base requête compte service application adresse lien transcription "
    "página sitio diálogo servidor archivo fichero documento recurso grabación sesión conexión base solicitud cuenta servicio aplicación dirección enlace transcripción".split()
)

#: What is said of them.
FAULTS = frozenset((
    "no longer exists", "no longer available", "existiert nicht", "existiert nicht mehr", "nicht mehr verfügbar", "nicht verfügbar", "nicht erreichbar", "zurzeit nicht erreichbar", "derzeit nicht erreichbar", "wird gewartet", "ist abgelaufen", "introuvable", "est introuvable", "n'existe plus", "n'existe pas", "n'est plus disponible", "n'est pas disponible", "indisponible", "en maintenance", "a été supprimé", "a été supprimée", "ya no existe", "no existe", "ya no está disponible", "no está disponible", "no disponible", "no encontrada", "no encontrado", "no se encontró", "no se ha encontrado", "no se pudo encontrar", "en mantenimiento", "en construction", "en construcción", "im aufbau", "in bearbeitung", "under construction",
    "for sale", "loading", "please wait", "bitte warten", "chargement", "cargando", "wird geladen",
    "not found", "error", "errors", "failed", "failure", "failed to", "unavailable", "not available", "isn't available", "does not exist", "doesn't exist", "do not exist", "was removed", "been removed", "been deleted", "been moved", "been suspended", "moved permanently", "could not be found", "couldn't be found", "cannot be found", "can't be found", "can't find", "cannot find", "couldn't find", "we can't find the",
    "could not be loaded", "couldn't be loaded", "cannot be loaded", "could not be reached", "can't be reached", "cannot be reached", "could not be resolved", "could not be opened", "could not be processed", "could not be completed", "cannot be displayed", "can't be displayed", "can't be opened", "unable to load", "unable to open", "unable to process", "unable to find", "unable to display",
    "is not responding", "isn't responding", "not responding", "is not working", "isn't working", "timed out", "time out", "timeout", "expired", "denied", "refused", "rejected", "invalid", "corrupted", "exceeded", "overloaded", "offline", "is down", "went wrong", "crashed", "interrupted", "blocked", "closed", "maintenance", "out of range", "exception", "refused to connect", "unexpected",
    "fehler", "fehlgeschlagen", "gescheitert", "nicht geladen werden", "nicht geöffnet werden", "nicht angezeigt werden", "nicht hergestellt werden", "nicht verarbeitet werden", "nicht gefunden", "gelöscht", "verschoben", "abgelaufen", "verweigert", "ungültig", "unterbrochen", "überlastet", "gesperrt", "reagiert nicht", "nicht erreichbar",
    "erreur", "échoué", "échec", "impossible de charger", "impossible d'ouvrir", "impossible d'afficher", "impossible de trouver", "n'a pas pu être", "ne peut pas être", "ne répond pas", "supprimé", "supprimée", "déplacé", "déplacée", "expiré", "expirée", "refusé", "refusée", "invalide", "interrompue", "surchargé", "bloqué",
    "error", "falló", "fallo", "fallido", "no se pudo cargar", "no se pudo abrir", "no se pudo mostrar", "no se puede abrir", "no se puede cargar", "no responde", "eliminado", "eliminada", "movido", "movida", "caducado", "caducada", "expirado", "denegado", "rechazada", "inválida", "no válida", "interrumpida", "saturado", "bloqueado",
))

#: What has to be switched on or replaced, and words that ask for it.
SCRIPTS = frozenset("javascript js cookies cookie scripts scripting script browser browsers flash navigateur navegador skripte".split())
DEMANDS = frozenset(
    "enable enabled activate allow requires require required needs need needed must disabled deactivated unable outdated upgrade update install unsupported turn switch switched support supported consent accept agree settings block blocks blocked blocking disallow "
    "aktivieren aktiviere aktiviert eingeschaltet einschalten zulassen benötigt erfordert deaktiviert ausgeschaltet veraltet aktualisieren unterstützt akzeptieren zustimmen blockiert "
    "activer activez autoriser autorisez nécessite nécessaire requis requise désactivé désactivés obsolète accepter acceptez consentir mettre bloque bloqués "
    "active activar active activate habilitar habilite permitir permita necesita requiere desactivado desactivadas desactualizado actualizar actualice admite aceptar acepte bloquea bloqueados".split()
)

#: Sentences that stand beside an error: they count where one does.
ADVICE = frozenset((
    "try again", "please check", "check back", "check the url", "check the address", "check your connection", "check your internet", "check the spelling", "contact the administrator", "contact the site", "contact support", "contact us", "go back", "back to home", "return to", "homepage", "home page", "start page", "reload", "refresh", "clear your cache", "clear the cache", "apologize", "apologise", "sorry", "inconvenience",
    "make sure the web address", "make sure that", "may have removed", "right now", "back online", "be back", "attackers might be trying", "by continuing", "continuing to use", "continue browsing", "you agree", "you consent", "you accept", "accept our", "update it", "upgrade it", "enable it", "disable it", "got it",
    "please wait", "a few minutes", "few moments", "stay tuned", "watch this space", "we are working on", "we're working on", "our team has been notified", "has been notified", "has been logged", "report this", "learn more", "see the log", "more information", "privacy policy", "use the search", "or search", "home | search", "skip to", "all rights reserved", "powered by", "for more details",
    "bitte versuchen", "erneut versuchen", "später noch einmal", "laden sie die seite neu", "seite neu", "neu laden", "zurück zur", "startseite", "prüfen sie", "überprüfen sie", "wenden sie sich", "administrator", "entschuldigen", "entschuldigung", "verständnis", "bitte warten", "stimmen sie", "einverstanden", "nutzung", "weiterer nutzung", "weitersurfen", "als platzhalter", "in kürze", "aktualisieren sie", "schauen sie", "bald wieder", "mehr erfahren", "datenschutz",
    "veuillez", "mettre à jour", "poursuivant votre navigation", "continuant à naviguer", "en continuant", "acceptez leur", "vous acceptez", "leur utilisation", "bientôt", "rechargez", "actualisez", "retour à l'accueil", "page d'accueil", "retournez", "vérifiez", "contactez", "administrateur", "désolé", "désolés", "excuses", "gêne occasionnée", "revenez", "en savoir plus", "réessayez", "confidentialité",
    "por favor", "si continúa", "sigue navegando", "continúa navegando", "acepta su uso", "acepta el uso", "aceptas su uso", "actualícelo", "recargue", "recarga", "actualice la página", "volver al inicio", "página de inicio", "vuelva", "compruebe", "verifique", "póngase en contacto", "contacte", "administrador", "lo sentimos", "disculpe", "disculpas", "molestias", "espere", "más información", "pronto", "privacidad",
))

#: The vocabulary around them; it covers words, but tells nothing by itself.
USUAL = frozenset(
    "dialogue content text user error errors code line dump export view show java scripts website inc py srv www vad minutes minute seconds second attempt attempts requested please visitor visitors experience features feature best function properly correctly works work only reload continue use using run hear load loading displayed display turns sorry oops whoops element warning fatal back later soon again help home search try trying "
    "message available human check below looks like peer owner moved deleted exists longer permission access log logs placeholder filled here own paragraph replace support administrator contact team moment temporary temporarily currently able complete completed process processed problem issue technical difficulties maintenance shortly ready details information main menu title description section image copyright encountered condition prevented fulfilling handle allow performing trouble finding visit followed broken link steal cache latest version newer another such chrome firefox safari edge options preferences device internet view this "
    "anmeldung bitte skript fehler browser neu laden kurze minuten inhalt inhalte text titel abschnitt beschreibung diese dieser dieses später erneut problem wartung technischen technisches einstellungen version funktionen anzeigen nutzen verfügbar aufrufen angeforderte gewünschte gesuchte kürze hier "
    "cette page lecteur navigateur demandée demandé recherchée minutes afficher écouter appel continuer désolé contenu texte titre section description paragraphe problème technique maintenance plus tard nouveau instants version fonctionnalités utiliser cliquez suivante ici réglages paramètres "
    "este esta sitio reproductor navegador solicitada solicitado buscada error código minutos diálogo párrafo contenido texto título sección descripción sesión permitidos ver problema técnico mantenimiento más tarde nuevo momento versión funciones utilizar continuar haga clic aquí ajustes configuración".split()
)

#: Left out of account when words are counted.
STOP = frozenset("dies er a an the to of in on for and or is are was be it its this that these you your we i my at by with as has have been not no only if out from will can der die das ein eine ist und zu um in sie ihr ihre ihren den dem es wir von auf für mit le la les l un une de du des et pour est à a dans ce se que qui en sur votre nous el los las una y su para es al lo del por".split())

#: Words of the usual pseudo-Latin filler, and those of them that are ordinary words of a language.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "sapien lectus quam tellus purus arcu vestibulum nunc mauris vitae ante felis pellentesque cras donec integer morbi nec neque orci pharetra porta praesent quisque risus sem semper suspendisse tincidunt turpis urna varius vel viverra volutpat".split()
)
COMMON_LATIN = frozenset("sit sed do ut et ad ex ea in esse eu non qui id est culpa dolor ante integer sem vel cras".split())

#: Keys hit and words repeated to fill a space.
KEYS = frozenset("xxx xxxx xx asdf qwerty qwertz azerty foo bar baz test testing bla blah blabla abc jkl hjkl dummy text sample".split())

#: What placeholders open with, folded.
OPENERS = ("{", "[", "<", "&lt;", "${", "#", "%", "@", "__", "_____", "......", "………", "~", "$", "*|", "«", "(", "todo", "fixme", "insert_", "undefined", "null", "nan", "xxxx")

#: Names of fields in templates.
FIELDS = frozenset(
    "site page name nickname surname firstname lastname fullname title date time id label place length city country address street email mail phone number no nr company user username agent caller guest host speaker session topic interview call customer client participant author recipient sender receiver patient doctor student teacher employee manager person contact party "
    "first last full middle subject order product item price amount total balance quantity currency url link website day month year week hour minute language role age gender birthday channel file interviewer value field text location duration code ref reference invoice account event venue room department position job project team school university hospital store shop brand model version status reason note comment message signature region state zip postcode "
    "nachname vorname datum ort stadt anrede kunde betrag firma nummer uhrzeit thema straße empfänger sprecher titel nom prénom ville adresse client montant heure société numéro sujet destinataire nombre apellido apellidos fecha ciudad dirección cliente importe hora empresa número tema destinatario lugar".translate(str.maketrans("áéíóúñßäöü", "aeiounsaou")).split()
)

#: Words between field names in brackets.
BETWEEN = frozenset("of the de del du des la le der von your and".split())

#: Sounds and signs of annotation that stand in brackets.
SOUNDS = frozenset(
    "skip laughter laugh laughs laughing noise sigh sighs cough coughs mn breath breathing silence inaudible unintelligible crosstalk pause music applause vocalized background static distortion lipsmack sneeze sniff click beep aside unclear foreign overlap chuckle chuckles gasp whisper humming singing phone ring door sic redacted edited omitted lachen husten räuspern pause rires rire toux risas risa tos silencio ruido bruit geräusch".split()
)

#: Requests for a value: the first or last word in brackets, words after which something comes, and what closes them.
INSERT = frozenset("insert enter add fill type write put specify choose select einfugen eintragen einsetzen eingeben erganzen inserer inserez saisir saisissez completer indiquer remplir ajouter insertar inserte introducir introduzca escriba escribir completar rellenar anadir indicar".split())
YOUR = frozenset("your ihr ihre ihren dein deine votre ton su tu".split())
HERE = frozenset("here hier ici aqui".split())
TO_FILL = ("to be filled in", "to be filled", "to be inserted", "to be added", "to be completed", "goes here", "auszufullen", "einzufugen", "a completer", "a remplir", "por completar", "por rellenar")
TO_DO = frozenset("tbd tba tbc todo fixme placeholder platzhalter".split())

#: What leads to a name: greetings, and words before a value (regular expressions, any case).
GREETINGS = r"dear|hello|hi|hey|hola|bonjour|bonsoir|salut|hallo|liebe[rs]?|liebe\(r\)|sehr geehrte[r]?(?: (?:frau|herr))?|cher|chère|estimad[oa]|querid[oa]|good (?:morning|afternoon|evening|day)|guten (?:morgen|tag|abend)|buen(?:os|as) (?:días|tardes|noches)|morning|welcome|thank you|thanks|mr\.?|mrs\.?|ms\.?"
SLOTS = r"name is|this is|here is|i am|i'm|speaking is|mein name ist|ich bin|hier ist|je m'appelle|je suis|ici|me llamo|mi nombre es|soy|by|from|with|on|for|of|to|von|mit|für|am|an|par|avec|pour|de|le|por|con|el|para|booked,|speaker|guest|caller|topic|title|name|date|in|at|called|is|since|ist|est|es"
NAMED = r"name is|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es"
#: What can follow a name (regular expressions, any case).
AFTER_VALUE = r"calling|speaking|here|and|lasted|lasts|was|were|in the|in|on|at|had|has|took|begins|ended|und|dauerte|war|hat|in der|im|am|et|a été|a duré|était|au|à|dans|y|fue|duró|era|en el|en la|en"
PRICES = r"costs?|cost|paid?|pays?|price|worth|only|about|than|over|under|of|spent?"
#: Words of a sentence that talks about a placeholder instead of leaving one unfilled (regular expressions, any case).
MENTIONS = (
    r"templates?|variables?|placeholders?|fields?|syntax|is written|are written|written as|is replaced|are replaced|replaced with|stands? for|means|such as|braces|brackets|the label|labels?\s+\w+\s+on|we kept|mark sounds|the value|the word|the string|the tag|the token|the code|printed|typed|returns|"
    r"vorlagen?|platzhalter|variablen?|felder|feld|steht für|bedeutet|geschrieben|klammern|das wort|modèles?|champs?|signifie|s'écrit|remplacée?s?|accolades|crochets|le mot|plantillas?|campos?|significa|se escribe|sustituyen?|reemplazan?|llaves|corchetes|la palabra"
)

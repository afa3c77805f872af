"""Cases and lookalikes of problem 8 that were written without the tables in view. The word lists were revised with the
rows at even positions; those at odd positions are held out and only counted."""

CASES = [
    # English: errors
    "This site can't be reached. DNS address could not be resolved.",
    "502 Bad Gateway\nnginx/1.18.0",
    "The requested URL /archive/2019 was not found on this server.",
    "Sorry, the page you are looking for could not be found. Please check the URL or go back to the homepage.",
    "HTTP Status 500 – Internal Server Error. The server encountered an unexpected condition that prevented it from fulfilling the request.",
    "Oops! Something went wrong on our end. Please refresh the page or try again later.",
    "Your connection is not private. Attackers might be trying to steal your information.",
    "We're having trouble finding that site. Check your internet connection.",
    "This content isn't available right now. The owner may have removed it.",
    "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
    "503 Service Temporarily Unavailable. The server is overloaded or down for maintenance.",
    "Error establishing a database connection",
    "Exception in thread \"main\" java.lang.NullPointerException\n    at Loader.read(Loader.java:42)",
    "Warning: mysqli_connect(): Access denied for user 'root'@'localhost' in /var/www/db.php on line 12",
    "Your session has timed out due to inactivity. Please log in again to continue.",
    "Access to this page has been denied because we believe you are using automation tools.",
    "Please complete the security check to access the website. Ray ID: 7f3c2a",
    "Sorry, you have been blocked. You are unable to access this website.",
    "This video is unavailable.",
    "The link you followed may be broken, or the page may have been removed.",
    "Fatal error: Allowed memory size of 134217728 bytes exhausted in index.php on line 3",
    "{\"error\": \"invalid_token\", \"message\": \"The access token expired\"}",
    "403 Forbidden. You don't have permission to access this resource.",
    "This account has been suspended. Contact your hosting provider for more information.",
    "We are currently performing scheduled maintenance. We will be back online shortly.",
    # English: notices
    "We use cookies to improve your experience. Accept all cookies to continue.",
    "Your browser is not supported. Please update it.",
    "JavaScript is disabled in your browser. Please enable it to proceed.",
    "You need to enable JavaScript to run this app.",
    "This website uses cookies to ensure you get the best experience. Learn more. Got it!",
    "To view this page, please switch on cookies in your browser settings.",
    "It seems you are using an ad blocker. Please disable it to view the content.",
    "Internet Explorer is no longer supported. Please use a modern browser such as Chrome or Firefox.",
    "Please turn JavaScript on and reload the page.",
    "By continuing to use this site you agree to our use of cookies.",
    # English: stubs and filler
    "Text goes here. Text goes here. Text goes here.",
    "This page is under construction. Please check back soon.",
    "Content coming soon!",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
    "This is a sample page. Replace this text with your own content.",
    "test test test test test test",
    "asdf asdf asdf qwerty asdf",
    "This page intentionally left blank.",
    "Click here to edit this paragraph and add your text.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    # English: placeholders
    "Dear [Recipient], your order [OrderNo] has shipped.",
    "Hello {patient_surname}, your appointment is tomorrow.",
    "Dear {{customer.firstName}}, thanks for calling us last week.",
    "Hi %FIRSTNAME%, we talked about the ferry on Monday.",
    "Please meet [insert name here] at the station.",
    "Dear <your name>, the recording of your call is ready.",
    "The interview took place in ${city} on ${date}.",
    "Signed by ______________ on the last day of the month.",
    "Thank you, [Your Company Name], for the invitation.",
    "The host of the evening is XXXX, who has been with us for years.",
    "My name is undefined and I will be your guide.",
    "Dear [FIRST NAME], we hope you are well.",
    "Welcome back, null! You have three new messages.",
    "Meet me at @@location@@ after the show.",
    "The price of the ticket is {{ price }} for members.",
    "Hello __USERNAME__, your package has arrived.",
    # German
    "Diese Seite ist leider nicht verfügbar. Bitte versuchen Sie es später erneut.",
    "Fehler 404: Die angeforderte Seite konnte nicht gefunden werden.",
    "Der Server ist derzeit nicht erreichbar.",
    "Es ist ein unerwarteter Fehler aufgetreten. Bitte wenden Sie sich an den Administrator.",
    "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
    "Sie haben keine Berechtigung, auf diese Seite zuzugreifen.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.",
    "Diese Website verwendet Cookies. Mit der Nutzung stimmen Sie dem zu. Mehr erfahren",
    "Ihr Browser wird nicht unterstützt. Bitte verwenden Sie eine neuere Version.",
    "Hier entsteht eine neue Internetpräsenz.",
    "Inhalt folgt in Kürze.",
    "Dies ist ein Blindtext. Er dient nur als Platzhalter.",
    "Sehr geehrte Frau {{nachname}}, vielen Dank für Ihren Anruf.",
    "Guten Tag [Name], Ihr Termin ist am [Datum].",
    "Bitte [hier Namen einfügen] anrufen.",
    "Mein Name ist ____________ und ich komme aus Berlin.",
    "Wartungsarbeiten: Die Seite ist vorübergehend nicht verfügbar.",
    "Verbindung zum Server wurde unterbrochen. Bitte laden Sie die Seite neu.",
    # French
    "La page que vous recherchez est introuvable.",
    "Erreur 500 : une erreur interne du serveur s'est produite.",
    "Le service est temporairement indisponible. Veuillez réessayer plus tard.",
    "Votre session a expiré. Veuillez vous reconnecter.",
    "Vous n'avez pas l'autorisation d'accéder à cette page.",
    "Ce site utilise des cookies. En poursuivant votre navigation, vous acceptez leur utilisation.",
    "Veuillez activer JavaScript dans votre navigateur pour continuer.",
    "Votre navigateur n'est pas pris en charge. Veuillez le mettre à jour.",
    "Page en construction. Revenez bientôt !",
    "Contenu à venir prochainement.",
    "Ceci est un texte de remplissage.",
    "Bonjour {{prenom}}, merci pour votre appel.",
    "Chère [Nom du client], votre commande est prête.",
    "Cher %NOM%, nous vous attendons demain.",
    "Je m'appelle ____________ et j'habite à Lyon.",
    "Impossible de charger la page. Vérifiez votre connexion.",
    "Le fichier demandé n'existe pas ou a été déplacé.",
    # Spanish
    "La página que busca no existe o ha sido eliminada.",
    "Error 404: página no encontrada.",
    "El servicio no está disponible en este momento. Inténtelo de nuevo más tarde.",
    "Su sesión ha expirado. Por favor, inicie sesión de nuevo.",
    "No tiene permiso para acceder a esta página.",
    "Este sitio web utiliza cookies. Si continúa navegando, acepta su uso.",
    "Por favor, habilite JavaScript en su navegador para continuar.",
    "Su navegador no es compatible. Actualice a una versión más reciente.",
    "Página en construcción. ¡Vuelva pronto!",
    "Próximamente más contenido.",
    "Este es un texto de relleno.",
    "Hola {{nombre}}, gracias por su llamada.",
    "Estimado [Nombre del cliente], su pedido está listo.",
    "Buenos días %NOMBRE%, le esperamos mañana.",
    "Me llamo ____________ y vivo en Sevilla.",
    "No se pudo cargar la página. Compruebe su conexión a Internet.",
    "Se ha producido un error inesperado. Póngase en contacto con el administrador.",
]

LOOKALIKES = [
    # English: real content about errors, scripts, templates, with markup or odd words
    "Yesterday the website told me the page was gone, so I phoned the office and they fixed it.",
    "My grandmother from Nan sent us a card.",
    "With null effort Bo won the race.",
    "I said to null hypothesis fans that evidence matters.",
    "We rated it from null to ten.",
    "In Roman numerals xxxx would be forty.",
    "The museum is closed on Mondays and the café opens at nine.",
    "She works as a server in a restaurant near the station.",
    "He couldn't find his keys, so we waited outside for an hour.",
    "The bridge is under construction, but you can take the ferry.",
    "Her new album is coming soon, and I've already ordered two copies.",
    "I baked cookies for the whole class and they were gone in minutes.",
    "The script of the play was written by a student from Leeds.",
    "Our teacher explained what an error 404 means and why it is called that.",
    "A: did you see the page? B: yes, it had a picture of the harbour on it.",
    "In my job I write JavaScript all day, mostly for maps.",
    "The forbidden forest is my favourite place in the book.",
    "They asked whether I was a robot, and I laughed.",
    "We lost the connection in the tunnel, but she called back right away.",
    "Access to the garden is free, though dogs are not allowed.",
    "I try again every year and one day I will finish the marathon.",
    "The email said my session had expired, which annoyed me because I had written so much.",
    "A good error message tells the user what happened and what to do next.",
    "The doctor said something went wrong with the first x-ray so they took another one.",
    "The recipe is easy: mix, bake, and serve.",
    "[noise] yeah [laughter] I know what you mean",
    "uh {breath} so we went to the lake",
    "We don't accept cookies from strangers, my mother used to say with a smile.",
    "Our browser history project looked at how people read news in 1999.",
    "Please enable the alarm before you leave the house tonight.",
    "The placeholder {name} is replaced by the caller's name when the letter is printed.",
    "In the template, the field [date] stands for the day of the interview.",
    "Write ${HOME} to get the folder of the user; the variable is set at login.",
    "I gave her $5 for the bus and she gave me $2 back.",
    "The chapter on voting ........ 17",
    "Well.... I suppose so......",
    "I think... no, wait, let me start over.",
    "My score was 95% and hers was 87%.",
    "Call me at the office, ask for Nan, and leave a message.",
    "The null result was published in a small journal last spring.",
    "Undefined behaviour is the part of the course that students fear most.",
    "The sample was tested twice in the lab and found to be clean.",
    "It was a test of patience: we waited for four hours.",
    "bla bla, he said, and then he left the room without another word.",
    "No, no, no, no, I never said that.",
    "Lorem ipsum is a text that printers have used since the sixteenth century to show typefaces.",
    "I enjoy Latin: amor vincit omnia is what my ring says.",
    "The page turner of the summer is a thriller about a lost recording.",
    "We have been working on the house since May and it will be ready in autumn.",
    "The shop was temporarily moved to Main Street, where it has more room.",
    "Do you want to update the guest list or is it fine as it is?",
    "She turned the light on and read until two.",
    "Nobody answered the phone, so the reporter tried the door.",
    "My file cabinet is blue and the key is in the drawer.",
    "The account of the journey fills three volumes and is a joy to read.",
    "You will find the entrance behind the church, next to the bakery.",
    "It's 404 miles from here to the border, said the driver.",
    "Room 500 is on the fifth floor, the internal stairs are to the left.",
    "The network of canals was built two hundred years ago.",
    "Her address is easy to remember: one, High Street.",
    "Is it possible to take the train to the airport after midnight?",
    # German
    "Gestern stand auf der Seite eine Fehlermeldung, also habe ich angerufen und es ging dann doch.",
    "Der Zug war nicht verfügbar, deshalb sind wir mit dem Bus gefahren.",
    "Meine Oma backt die besten Cookies und verrät das Rezept nicht.",
    "Im Drehbuch steht ein Fehler, den der Regisseur sofort bemerkt hat.",
    "Wir haben von null auf hundert neu angefangen.",
    "Das Haus ist noch im Bau, aber wir ziehen im Mai ein.",
    "Der Platzhalter {name} wird durch den Namen des Anrufers ersetzt.",
    "Ich lerne gerade JavaScript und finde es gar nicht so schwer.",
    "Die Brücke ist wegen Bauarbeiten gesperrt, wir nehmen die Fähre.",
    "Er hat den Schlüssel nicht gefunden und musste draußen warten.",
    "Der Termin ist abgelaufen, aber die Behörde war freundlich.",
    "Die Kellnerin hat die Anfrage vergessen, das Essen war trotzdem gut.",
    "Auf Seite 12 beginnt die Geschichte erst richtig.",
    "Das Museum bleibt montags geschlossen.",
    "Der Roboter im Film war mein Lieblingscharakter.",
    "Sie hat mir die Aufnahme geschickt, und wir haben sie zusammen gehört.",
    "Mein Vater repariert alte Radios und hat Geduld.",
    # French
    "Hier la page affichait une erreur, alors j'ai téléphoné et tout s'est arrangé.",
    "Le pont est en construction, prenez le bac.",
    "Ma mère prépare des cookies tous les dimanches.",
    "Le script du film a été écrit par une étudiante de Lyon.",
    "Il a cherché ses clés partout et ne les a pas trouvées.",
    "Le champ {nom} du modèle est remplacé par le nom du client.",
    "Je travaille en JavaScript depuis trois ans et ça me plaît.",
    "Le musée est fermé le lundi.",
    "La session de chant commence à huit heures dans la grande salle.",
    "Le serveur du café nous a apporté deux thés.",
    "L'accès au jardin est gratuit pour les enfants.",
    "Mon adresse est facile à retenir.",
    "Il y a une erreur dans la recette : il faut deux œufs.",
    "La page douze du livre est ma préférée.",
    "Nous avons perdu la connexion dans le tunnel mais elle a rappelé tout de suite.",
    # Spanish
    "Ayer la página mostraba un error, así que llamé y lo arreglaron.",
    "El puente está en construcción, hay que tomar el barco.",
    "Mi abuela hace galletas, no cookies, dice ella.",
    "El guion de la obra lo escribió una estudiante de Granada.",
    "Buscó las llaves por toda la casa y no las encontró.",
    "El campo {nombre} de la plantilla se sustituye por el nombre del cliente.",
    "Trabajo con JavaScript desde hace tres años y me gusta.",
    "El museo está cerrado los lunes.",
    "La sesión de canto empieza a las ocho en la sala grande.",
    "El camarero nos trajo dos cafés y una tarta.",
    "El acceso al jardín es gratuito para los niños.",
    "Mi dirección es fácil de recordar.",
    "Hay un error en la receta: hacen falta dos huevos.",
    "La página doce del libro es mi favorita.",
    "Perdimos la conexión en el túnel pero ella volvió a llamar enseguida.",
]

#: Written and revised with later; not held out.
MORE_CASES = [
    "Page Not Found",
    "Error code: 0x80070005",
    "We'll be right back.",
    "Please wait while we verify your browser.",
    "You don't have access to this page.",
    "Hello [First Name]!",
    "Dear Mr. [Last name], thank you for your call.",
    "Dear {CUSTOMER}, your bill is ready.",
    "INSERT_NAME_HERE",
    "Thanks to [COMPANY_NAME] for the support.",
    "TODO: write description",
    "Loading...",
    "Hi {{first_name}}, welcome to the show.",
    "This page can't be displayed. Make sure the web address is correct.",
    "The server is temporarily unable to service your request due to maintenance downtime.",
    "HTTP ERROR 404. The page could not be found.",
    "Unable to load the transcript. Try again later.",
    "Das Dokument wurde nicht gefunden.",
    "Une erreur inattendue est survenue. Veuillez réessayer plus tard.",
    "No se ha encontrado la página solicitada.",
    "Please allow cookies in your browser settings.",
    "JavaScript muss aktiviert sein, um diese Seite anzuzeigen.",
    "Cette page nécessite JavaScript.",
    "Para usar esta página active JavaScript.",
    "Blah blah blah blah blah.",
    "Lorem ipsum dolor",
    "Sehr geehrter Herr [Nachname], wir danken Ihnen.",
    "Bonjour [Prénom], merci.",
    "Dear Sir or Madam ______, we thank you.",
    "Call from: {{caller_name}} to: {{callee_name}}",
    "Interview with %INTERVIEWEE% on Monday",
    "Uncaught ReferenceError: turns is not defined at viewer.js:12",
    "KeyError: 'transcript'",
    "Fehler beim Laden der Seite.",
    "Erreur lors du chargement de la page.",
    "Error al cargar la página.",
    "Access Denied - You do not have permission to view this directory or page.",
    "This domain is for sale.",
    "Checking if the site connection is secure",
    "Content is not available in your country.",
    "Sorry, this recording is no longer available.",
    "Your request timed out. Please reload.",
    "Welcome to [Site Name], the best place for news.",
]
MORE_LOOKALIKES = [
    "She said page 404 of the book was missing.",
    "I saw an error in the bill and they fixed it.",
    "My internet was down so I read a book.",
    "We were told the file had been lost in the fire.",
    "[laughter] that was the best part",
    "Dear [laughter] friends",
    "{sneeze} excuse me",
    "I have [um] no idea",
    "He works with servers in a data center and likes it.",
    "The form asked for my name and address.",
    "Mr. Null lives on Undefined Street.",
    "The access to the beach is denied to dogs.",
    "Please enable subtitles so that we can follow.",
    "We need to update the browser on my grandmother's computer tomorrow, said Bo, because she wants to see the photos.",
    "Cookies are in the jar.",
    "The library is temporarily closed.",
    "I got a 500 dollar fine.",
    "It is forbidden to smoke here, the guard told us twice.",
    "The password expired and I had to call IT.",
    "My session with the therapist went well.",
    "Bo wrote {hello} on the wall",
    "A: null B: love",
    "The variable x is null in that case.",
    "In the second set she won six to love.",
    "We couldn't connect on Tuesday, so I'm calling now.",
    "Try again, you almost had it!",
    "Sorry, I missed your call.",
    "Thanks for waiting.",
    "It's not available in blue, only in red.",
    "La tienda no está disponible los domingos.",
    "Le magasin est en maintenance jusqu'à lundi, a dit le gardien.",
    "Der Aufzug ist nicht verfügbar, nehmen Sie die Treppe.",
    "The road no longer exists.",
    "That doesn't exist.",
    "Nous avons demandé la page au bibliothécaire.",
]

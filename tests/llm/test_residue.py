"""Problem 8: cases and content that only looks like one."""

import pytest

from turnweave.llm import residue as R

PLACEHOLDERS = [
    "Dear {{name}}, thank you.", "Recorded on {{ call.date in the studio.", "Hi ${user_name}!", "Hello #{guest}", "By <%= host %> today", "{% title %} is here", "Dear %(caller)s, thanks", "this is %guest% calling", "Speaker: [[host-nickname]], channel 0.",
    "Hola @@agent_label@@, gracias", "Hallo __callerTitle__, danke", "Summary for ~topic_id~: see", "Dear $user_name$, hi", "Recorded by *|NAME|* twice", "From <<session.id>> on", "Dear &lt;city-name&gt;, hi", "Call <INSERT CALLER-NAME> now", "[INSERT TITLE HERE] spoke",
    "with <date goes here> and", "to [your speaker_name] now", "(guest to be filled in)", "Speaker: TODO: add label, channel 0.", "Your table is booked, [TBD].", "Summary for FIXME: see below.", "Good morning XXXX and welcome", "Dear {0}, thanks", "The caller from %s was hard to hear.",
    "Speaker: {guestId}, channel 0.", "Hola [NAME], gracias", "Recorded on {interview_date} in the studio", "The interview with .......... lasted", "This call was recorded by ____________ and checked", "Dear undefined, thank you", "A: my name is null", "Summary for NaN: see below.", "Your table is booked, $1.", "from [object Object] was",
]

RESIDUE = [
    "404 Not Found", "Error 500: Internal Server Error\n\nCould not connect to the database on attempt 74.", "Weekly summary Losti 171\nSed amet ipsum et adipiscing ut aliqua eiusmod dolore consectetur do tempor elit magna.", "Guide Kapa 499: Your text here. Replace this paragraph with your own transcript.",
    "Please enable scripting to use the dialogue viewer.\n\n[ OK ]", "Without JavaScript the turns on this page can't be displayed.", "Désolé !\nVotre session a expiré, reconnectez-vous.", "Interner Serverfehler. Bitte versuchen Sie es später noch einmal.\nHome | Search | Help", "La página solicitada ya no existe.",
    "Traceback (most recent call last):\n  File \"loader.py\", line 18, in <module>\nIndexError: out of range\nRequest id dda084dd", "xxx xxx xxx xxx xxx xxx", "Notas 3\nContenido próximamente. Esta página es provisional.", "It looks like cookies are disabled. Some features of the dialogue viewer need it.", "eRRor 404: nOt fOUnd", "VOTRE SESSION A EXPIRÃ©, RECONNECTEZ-VOUS.",
]

CONTENT = [
    None, "", "   \n", "​", "A: I kept getting a page saying it was not found when I tried to book.\nB: yeah same here, I called them instead.", "USER: my screen shows error 500, what does it mean?\nASSISTANT: It means the server has a fault; wait 89 minutes and retry.",
    "The speaker Govo read a filler text starting with lorem ipsum in take 27 because the prompts had been lost.", "In the mail template the field {{caller}} is replaced with the caller's name before sending.", "The variable is written ${rate} in the script; its value was 5900 Hz.",
    "Rule 3: curly braces such as {laugh} mark sounds, and a word like {vaccinewise} is a coinage.", "Note 75: [[skip]] means the annotator left a stretch out.", "12.0 13.0 A: well {laugh} [noise] [laughter-so] [[skip]] %um ((i)) **see** +it+ <b_aside> <German no>", "We kept the label TODO on 72 tapes until Tuda had heard them all.",
    "The price was null, said Bo, and 54 people laughed.", "Why the channel was undefined in the contract.", "Bo teaches JavaScript at the evening school and says most students enable each other to finish.", "agent: please enable the second channel\nuser: done, and the browser shows 9 scripts for the play",
    "We met in room 404, next to the ferry, and Bator brought 77 chairs.", "It costs $5 or 64 % of $1", "La secrétaire a écrit « votre nom ici » sur 9 cartes, puis les invités ont mis le leur.", "Rare dijo que la página no encontrada era la 28 del libro de recetas.", "No no no no.", "We're going to fix it with Nanimun tomorrow.",
]


@pytest.mark.parametrize("text", PLACEHOLDERS)
def test_placeholder(text):
    assert R.judge(text) == "placeholder"
    assert R.judge("The salty one belongs to Bo. " + text + "\nNobody found the sandwich.") == "placeholder"


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert R.judge(text) == "residue"


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert R.judge(text) is None


def test_error_in_long_content():
    text = "404 Not Found\n" + "Nobody found the sandwich so Bo had to explain it. " * 3000
    assert R.judge(text) is None


def test_dataframe(spark):
    rows = [(1, "404 Not Found", "a", "z"), (2, "fine words here", None, None), (3, None, "a", "z"), (4, "Dear {{name}}, hi", "a", "z"), (1, "404 Not Found", "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    assert sorted(r["doc_id"] for r in R.found(df).collect()) == [1, 4]
    assert sorted(map(str, R.clean(df).collect())) == sorted(map(str, df.where("doc_id in (2, 3)").collect()))
    assert {(r["source"], r["kind"]): r["documents"] for r in R.report(df).collect()} == {("a", "residue"): 2, ("a", "placeholder"): 1, ("a", "kept"): 1, (None, "kept"): 1}
    assert R.found(df.limit(0)).count() == 0
    assert R.mark(df, out="Kind").where("doc_id = 4").first()["Kind"] == "placeholder"


@pytest.mark.parametrize("text", ['"' * 300_000, "[" * 300_000, "{{" * 100_000, "_" * 300_000, "." * 300_000, "x" * 300_000, "( " * 100_000, "not found " * 30_000])
def test_odd_and_long(text):
    R.judge(text)

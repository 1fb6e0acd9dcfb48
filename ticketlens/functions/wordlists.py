"""Fixed word lists used as defaults. All of them can be replaced by parameters."""

# --- Fixed values: keywords whose presence marks a complaint -------------------------
COMPLAINT_KEYWORDS = (
    "complaint", "issue", "problem", "broken", "defective", "error", "fail", "failed",
    "failure", "refund", "return", "damaged", "wrong", "missing", "lost", "overcharged",
    "charge", "dispute",
)

# --- Fixed values: entity types kept by default --------------------------------------
ENTITY_TYPES = ("PERSON", "ORG", "PRODUCT", "DATE", "MONEY", "GPE")

# --- Fixed values: entity words and priorities that make a ticket critical -----------
CRITICAL_ENTITY_WORDS = (
    "refund", "lawsuit", "legal", "escalation", "complaint", "regulatory", "safety",
)
CRITICAL_PRIORITIES = ("critical", "urgent", "p1")

# --- Fixed values: reasons given to flagged tickets, in order of precedence ----------
FLAG_REASONS = (
    "High negative sentiment",
    "Expensive/critical entity mention",
    "High priority ticket",
)

# --- Fixed values: candidate column names, first present one wins --------------------
TEXT_COLUMNS = ("text_clean", "text", "ticket_text", "body")
TIME_COLUMNS = ("created_at", "timestamp", "date")
TOPIC_COLUMNS = ("topic_label", "topic")

# Opinion words by valence; a small default lexicon in half-point steps.
_VALENCES = {
    3.0: "excellent outstanding perfect superb",
    2.5: "amazing awesome brilliant delighted fantastic love wonderful",
    2.0: "good great happy impressed pleased recommend satisfied thrilled",
    1.5: "appreciate enjoy friendly glad helpful nice reliable resolved thank thanks",
    1.0: "clear easy fast polite prompt quick smooth useful welcome working",
    -1.0: "confusing delayed dirty error late missing problem slow stuck wrong",
    -1.5: "annoying bad broken complaint damaged defective disappointed failed poor ruined unfair unsafe",
    -2.0: "angry awful fraud frustrated lawsuit rude trash unacceptable upset useless",
    -2.5: "clown disgusting furious hate horrible idiot loser moron pathetic scum stupid terrible worthless",
    -3.0: "appalling catastrophic disgraceful worst",
}
LEXICON = {word: valence for valence, words in _VALENCES.items() for word in words.split()}

# Degree words: raise or lower the strength of the opinion word that follows.
BOOSTERS_UP = tuple(
    "absolutely completely deeply entirely especially exceptionally extremely fully greatly highly "
    "hugely incredibly intensely more most particularly purely quite really remarkably so "
    "substantially thoroughly totally tremendously unbelievably utterly very".split()
)
BOOSTERS_DOWN = tuple(
    "almost barely hardly kinda less little marginally occasionally partly scarcely slightly "
    "somewhat".split()
)
NEGATIONS = tuple(
    "aint cannot cant dont without neither never no nobody none nope nor not nothing nowhere "
    "rarely seldom".split()
)

# Phrases that count as one word: with a valence, as a degree word, as a negation, or without either (None).
PHRASE_VALENCES = {
    "let down": -2.0, "fed up": -2.0, "waste of time": -2.5, "rip off": -2.5, "out of order": -1.5, "top notch": 3.0, "well done": 2.0, "worth every penny": 2.5,
    "pain in the neck": -2.0, "second to none": 3.0,
}
PHRASE_BOOSTS = {
    "kind of": -0.293, "sort of": -0.293, "a bit": -0.293, "more or less": -0.293, "by far": 0.293, "without doubt": 0.293, "without a doubt": 0.293,
    "never so": 0.293, "beyond words": 0.293,
}
PHRASE_NEGATIONS = ("no longer", "far from", "by no means", "anything but")
PHRASES_WITHOUT_EFFECT = ("not only", "no wonder", "for nothing")
EMOTICONS = {":)": 2.0, ":-)": 2.0, ":D": 2.5, ";)": 1.0, "<3": 2.5, ":(": -2.0, ":-(": -2.0, ":'(": -2.5, ":/": -1.0}

STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further get "
    "had has have having he her here hers him his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours out over own same she should so "
    "some such than that the their theirs them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your yours".split()
)

"""Fixed values.

The values in this module must equal the ones the analysed workflows use, or
results change.  They are stated plainly, in their natural order.
"""

# --- fixed values: emotion ids of the utterance tagger (id -> name) ---------
TAG_EMOTIONS = [
    (0, "neutral"),
    (1, "joy"),
    (2, "surprise"),
    (3, "anger"),
    (4, "sadness"),
    (5, "disgust"),
    (6, "fear"),
]

# --- fixed values: valence / arousal / dominance anchor of each emotion -----
# in thousandths, same order as TAG_EMOTIONS.
EMOTION_ANCHORS_MILLI = {
    "neutral": (0, 0, 0),
    "joy": (760, 480, 350),
    "surprise": (400, 670, -130),
    "anger": (-430, 670, 340),
    "sadness": (-630, 270, -330),
    "disgust": (-600, 350, 110),
    "fear": (-640, 600, -430),
}

# --- fixed values: emotion codes used by the pattern analysis ---------------
# 'disgust' and 'love' share code 6.
PATTERN_CODES = [
    ("neutral", 0),
    ("joy", 1),
    ("surprise", 2),
    ("anger", 3),
    ("sadness", 4),
    ("fear", 5),
    ("disgust", 6),
    ("love", 6),
]

# --- fixed values: emotion names of the annotated corpus and their codes ----
ANNOTATION_CODES = [
    ("Joyful", 0),
    ("Mad", 1),
    ("Neutral", 2),
    ("Sad", 3),
    ("Scared", 4),
    ("Powerful", 5),
    ("Peaceful", 6),
]

# --- fixed values: trait flag columns and their short names -----------------
TRAITS = [("cAGR", "A"), ("cCON", "C"), ("cEXT", "E"), ("cOPN", "O"), ("cNEU", "N")]

# --- fixed values: dialogue lengths and seeds of the pair sweep -------------
FLOW_LENS = [0.25, 0.5, 0.75, 1.0]
SEEDS = [0, 42, 3407, 1, 2, 3, 4, 5, 6, 7]

# --- fixed values: VAD -> Big Five coefficients (rows E, A, C, N, O) --------
# Applied in this order; A is overwritten before C, N and O read it.
BIG_FIVE_COEF = {
    "E": (0.23, 0.12, 0.82),
    "A": (0.83, 0.19, -0.21),
    "C": (0.32, 0.00, 0.30),
    "N": (0.57, -0.65, 0.00),
    "O": (0.00, -0.33, 0.67),
}

# --- fixed values: trait feature scale of the fused model -------------------
TRAIT_SCALE = {"A": 10.0, "C": 10.0, "E": 10.0, "O": 10.0, "N": 100.0}

# --- fixed values: prompt phrases of the affective prompt -------------------
PROMPT_FIRST_OTHERS = "First, the emotion of others is "
PROMPT_FIRST_SELF = ("The emotion of ", " is initially ")
PROMPT_OTHERS = "the emotion of others is "
PROMPT_SELF = " respond with "

# --- fixed values: pair template (text_a, text_b, mask) ---------------------
PAIR_TEMPLATE = ("", " ; ", "; Is it correct? ", ".")
QUESTION_TEMPLATE = ("", " Question: ", "? Is it correct? ", ".")
MASK_TOKEN = "<mask>"

# --- test fixture values (FIXTURES.md) --------------------------------------
FIXTURE_LEXICON_WORDS = (
    "that it for was on as with by be from this are at he or an de der la die "
    "en que le und les er re th es ed ha st tion den ou von"
).split()
FIXTURE_STOPWORDS = ["the", "of", "and", "to", "a", "in", "is"]

# Hypothesis descriptions per (trait, polarity), written for this library.
DESCRIPTIONS = [
    ("A", "pos", "tends to be warm, helpful and considerate, and cares about getting along with people."),
    ("A", "neg", "tends to be blunt, argumentative and self-focused, and cares little about pleasing people."),
    ("C", "pos", "tends to be careful, reliable and well planned, and follows through on what was promised."),
    ("C", "neg", "tends to be careless, spontaneous and unplanned, and often leaves tasks unfinished."),
    ("E", "pos", "tends to be talkative, lively and outgoing, and draws energy from being around people."),
    ("E", "neg", "tends to be quiet, reserved and private, and recharges best when left alone."),
    ("O", "pos", "tends to be curious, imaginative and open to unfamiliar ideas and experiences."),
    ("O", "neg", "tends to be conventional, cautious and attached to familiar routines and views."),
    ("N", "pos", "tends to be anxious, easily upset and quick to feel stress and self-doubt."),
    ("N", "neg", "tends to be calm, steady and relaxed, and stays composed under pressure."),
]

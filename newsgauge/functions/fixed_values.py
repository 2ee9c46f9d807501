"""Constants that results must agree on. Plain text, natural order."""

# --- columns -----------------------------------------------------------------------
FEATURES = ["vreg", "eireg_anger", "eireg_fear", "eireg_joy", "eireg_sadness"]
AFFECT_COLUMNS = ["vreg", "voc", "eireg_anger", "eireg_fear", "eireg_joy", "eireg_sadness"]
INTENSITY_EMOTIONS = ["anger", "fear", "joy", "sadness"]
VREG_BUCKETS = ["negative", "neutral", "positive"]
LABELS = ["fake", "real"]
UNUSED_COLUMNS = ["id", "top_img", "authors", "publish_date", "movies", "images"]

# --- emotion vocabulary of the detection task ----------------------------------------
EMOTIONS = [
    "anger", "anticipation", "disgust", "fear", "joy", "love",
    "optimism", "pessimism", "sadness", "surprise", "trust",
]

# --- thresholds and sizes ------------------------------------------------------------
MIN_TEXT_CHARS = 20
MAX_PROMPT_CHARS = 350
EMBED_RETRY_CHARS = [250, 150, 80]
SNIPPET_CHARS = 800
EXPLANATION_CHARS = 200
NULL_PERCENT_LIMIT = 70
HIGH_EMOTION = 0.5
MISSING_FEATURE = 0.5
SAMPLE_ROWS = 15_000
SEED = 42

# --- cells that a CSV scan treats as missing -------------------------------------------
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
SENTINEL = "na"

# --- Unicode whitespace, as stripped from both ends of a text ----------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- number patterns in model replies ------------------------------------------------------
FLOAT_PATTERN = r"[-+]?\d*\.?\d+"
INT_PATTERN = r"-?\d+"

# --- verdicts -----------------------------------------------------------------------------
DEFAULT_VERDICT = "INSUFFICIENT_EVIDENCE"
DEFAULT_CONFIDENCE = 0.5
SNIPPET_SEPARATOR = "\n\n---\n\n"

# --- prompt texts --------------------------------------------------------------------------
VREG_PROMPT = (
    "Human:\nTask: Evaluate the valence intensity of the writer's mental state "
    "based on the text, assigning it a real-valued score from 0 (most negative) "
    "to 1 (most positive).\nText: {text}\nIntensity Score:\n\nA:\n>>"
)
VOC_PROMPT = (
    "Human:\nTask: Categorize the text into an ordinal class that best characterizes "
    "the writer's mental state, considering various degrees of positive and negative "
    "sentiment intensity. 3: very positive mental state can be inferred. "
    "2: moderately positive mental state can be inferred. "
    "1: slightly positive mental state can be inferred. "
    "0: neutral or mixed mental state can be inferred. "
    "-1: slightly negative mental state can be inferred. "
    "-2: moderately negative mental state can be inferred. "
    "-3: very negative mental state can be inferred\n"
    "Text: {text}\nIntensity Class:\n\nA:\n>>"
)
EIREG_PROMPT = (
    "Human:\nTask: Assign a numerical value between 0 (least E) and 1 (most E) "
    "to represent the intensity of emotion E expressed in the text.\n"
    "Text: {text}\nEmotion: {emotion}\nIntensity Score:\n\nA:\n>>"
)
EC_PROMPT = (
    "Human:\nTask: Categorize the text's emotional tone as either "
    "'neutral or no emotion' or identify the presence of one or more of the given "
    "emotions (anger, anticipation, disgust, fear, joy, love, optimism, pessimism, "
    "sadness, surprise, trust).\nText: {text}\nThis text contains emotions:\n\nA:\n>>"
)
QUERY_INSTRUCTION = (
    "You are a search query generator.\n"
    "Given a news article, generate ONE concise search query for a search engine\n"
    "that would find evidence to verify or debunk it. Do not be too general we need to "
    "specifically get infomration arround the article not general infromation.\n"
    "Output only the query — no explanation, no punctuation at the end."
)
QUERY_MESSAGE = "News article: {text}"
VERDICT_INSTRUCTION = (
    "You are a fact-checking assistant.\n"
    "You will be given a news article and web evidence retrieved about it.\n"
    "Your job is to decide if the evidence supports or contradicts the article.\n"
    "Respond ONLY with valid JSON in exactly this format:\n"
    "{\n"
    '  "verdict": "SUPPORTED" or "CONTRADICTED",\n'
    '  "confidence": <number 0.0 to 1.0>,\n'
    '  "explanation": "<one sentence explaining your decision>",\n'
    '  "supporting_sources": ["<url>"],\n'
    '  "contradicting_sources": ["<url>"]\n'
    "}\n"
    "Output only the JSON. No preamble. No explanation outside the JSON."
)
VERDICT_MESSAGE = (
    "News article to verify:\n{article}\n\n"
    "Tavily summary: {summary}\n\n"
    "Web evidence:\n{evidence}\n\n"
    "Based on this evidence, is the article supported or contradicted?"
)
SNIPPET = "Source: {url}\nTitle:  {title}\nText:   {content}"

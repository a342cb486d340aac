"""Fixed values that must equal the reference study's for equal results.

Everything in this module is data, not logic: term lists, tag sets, labels
and the prompt template. Lists are in their natural (source) order, because
sequential redaction depends on the order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: tag sets
# ---------------------------------------------------------------------------
ALL_TAGS = ["afrm", "agnt", "brdn", "dmnd", "fitt", "just", "prbl", "rbnd", "refl"]
TARGETS = ["afrm", "agnt", "fitt", "refl"]
THEMES = ["brdn", "dmnd", "prbl", "rbnd"]
LLM_CODES = ["afrm", "agnt"]
CYCLE_TAG_COLUMNS = ["prbl", "refl", "just", "afrm", "fitt", "agnt", "brdn", "dmnd", "rbnd", "rtnl", "note"]
CYCLE_DROP_COLUMNS = ["EmailPairID", "WithinPatientID", "FirstInPair"]
ID_COLUMNS = ["EmailPairID", "WithinPatientID", "FirstInPair", "MHP ID", "Unique ID", "pilot", "note"]
RAW_SHEET_DROP = ["Email Address", "Client Name", "INBOX Line", "RAW Message"]
CONDENSED_ORDER = ["EmailPairID", "WithinPatientID", "FirstInPair", "MHP ID", "Unique ID", "pilot", "text"]
SENTINEL_ID = "___"
KAPPA_BENCHMARK = 0.75

# ---------------------------------------------------------------------------
# FIXED VALUES: redaction terms
# ---------------------------------------------------------------------------
# Informal redaction markers, removed before the name list.
MANUAL_MARKERS = ["<PII>", "<|PII|>", "[MHP NAME]", "[CITY]", "[PATIENT NAME]", "[PHONE NUMBER]", "[URL]"]

# Prospective client names (one word each, file order).
CLIENT_NAMES = """
Aaliyah Darnell Alejandra Alejandro Amy Brian Aisha DeAndre Ariana Antonio
Carrie Daniel Ashanti Delroy Camila Armando Deborah Hunter Divine Jaleel
Daniela Carlos Erica Jay Heaven Jamal Florencia Diego Heidi Luke
Keisha Jermaine Gabriela Emilio Joan Robert Kenya Kareem Juanita Esteban
Katie Scott Keyana Kevon Lucia Felipe Lisa Seth Kimani Lamar
Mariana Fernando Stephanie Steven Monique Leroy Martina Ignacio Susan Shania
Marques Raquel Javier Tamia Marquise Valeria Jorge Taniya Rasheed Pablo
Tionna Terell Pedro Tyra Terrell Rafael Tyrone Rodrigo Santiago Valentino
""".split()

# Construct salience delimiter tokens removed from training text.
SALIENCE_TOKENS = ["<|AFRM|>", "<|AGNT|>", "<|BRDN|>", "<|DMND|>", "<|FITT|>",
                   "<|JUST|>", "<|PRBL|>", "<|RBND|>", "<|REFL|>"]

# Entity labels whose spans are redacted.
PII_LABELS = ["PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT"]
PII_TOKEN = "<|PII|>"
# This library's default: those and what its own recogniser finds.
REDACT_LABELS = [*PII_LABELS, "EMAIL", "PHONE"]

# ---------------------------------------------------------------------------
# FIXED VALUES: LLM prompt pieces
# ---------------------------------------------------------------------------
# {name} and {alias} are substituted per code.
DEFINITION_TEMPLATE = '\nDefinition of "{name}": {definition}\n'
INSTRUCTION_TEMPLATE = """
You will be provided with a piece of text. For each piece of text:
- If it meets the definition of "{name}," respond with "{alias}_1"
- Otherwise, respond with "0".
- You must choose a "{alias}_1" or a "0" response.
- If your response is "{alias}_1," then begin a new paragraph with "{alias}_rationale:" and excerpt the sentences or
phrases that determined your decision. You are allowed to choose multiple sentences or phrases, divided by an
"<|SPL|>" token.
- Then, whether you have selected a "{alias}_1" or a "0," begin a new paragraph with "{alias}_explanation:" and provide
a two sentence explanation for your response.
"""
DECISION_MARKER = "{alias}_1"
RATIONALE_MARKER = "{alias}_rationale:"
EXPLANATION_MARKER = "{alias}_explanation:"
ERROR_REPLY = "error"

CODEBOOK_ROLE = (
    "You are tasked with applying pre-defined qualitative codes to emails by mental health professionals (MHPs)\n"
    "such as counselors, psychologists, and clinical social workers, replying to prospective clients.\n"
    "\n"
    "You will be provided a definition, instructions, and key exemplars of text to guide your coding decisions.\n"
)

# Codebook rows: (alias, name, definition, clarification, examples); strings
# verbatim as the YAML loader yields them (block scalars keep one trailing
# newline; folded ones join lines with a space).
CODEBOOK = [
    ("afrm", "Affirm",
     "Responding in a manner that explicitly reinforces prospective client's decision to seek therapy.\n",
     "- Affirmation of treatment-seeking must be explicit\n"
     "- Acknowledgements of the difficulty in seeking care fulfill the definition of \"Affirm\"\n"
     "- Expressions of gratitude alone (\"thank you for reaching out\") do _not_ fulfill the definition of \"Affirm\"\n"
     "- Ambiguous positive responses do _not_ fulfill the definition of \"Affirm\"\n",
     "Below are human-validated examples of \"Affirm\"\n"
     "\"It takes bravery to ask for help, and I'm glad you made the choice <|PII|>.\"\n"
     "\"How amazing to take this first step, it can be tough decision to make, but I believe it is often the right one.\n"),
    ("agnt", "Agent",
     "Interfacing with a prospective client via an automatic message or non-MHP staffer such as a scheduler or office coordinator.\n",
     "- Responses in which a clinician responds first, even to hand off to a scheduler, do _not_ fulfill the definition of \"Agent.\"\n",
     "Below are human-validated examples of \"Agent\"\n"
     "\"Thank for choosing <|PII|> Counelling Center. We are eager to assist you. First, please reply to this message with your insurance details.\"\n"
     "\"We received your message regarding starting therapy with Dr. <|PII|>. She does currently have availability. We will need the folloing information.\"\n"),
    ("brdn", "Burden",
     "MHPs interjecting and describing administrative burden as reality of provisioning social services\n",
     "- Any response in which an MHP requires >2 additional steps from a client before therapy can begin fulfills the \"Friction\" definition\n",
     "Below are human-validated examples of \"Burden\"\n"
     "\"Thank you for contacting<|PII|> Services. Before we can arrange an appointment, please take a moment to create an account on our\n"
     "scheduling portal, enter your address and telephone information, and provide valid insurance, including uploading a photo of\n"
     "your insurance card.\"\n"),
    ("fitt", "Fit",
     "Explicitly mentioning the importance of client-MHP rapport, and/or alliance in a client-empowering manner.\n",
     "- Characteristic terms may include \"fit,\" \"match,\" \"compatibility.\"\n",
     "Below are human-validated examples of \"Fit\"\n"
     "\"I prefer to schedule a gratis 30-minute call to be sure we'll be a good fit for each other.\"\n"
     "\"In the initial session, we can discuss our compatability in working toward your therapy goals.\"\n"
     "\"Let's first set aside an introductory session to explore your needs and assess our fit.\"\n"),
    ("rbnd", "Rebound",
     "Multiple burdensome queries imposed on the prospective client in response to appointment-seeking inquiries\n",
     "- More than 2 consecutive questions directed at a client fulfill the definition of \"Rebound.\"\n"
     "- Consecutive questions may be embedded within a single sentence\n",
     "Below are human-validated examples of \"Rebound\"\n"
     "\"First, does your insurance reimburse formental health and if so whichinsuranceis it?\"\n"
     "\"Are you able to meet in person? Will you require special accomdoations? When did your symptoms begin, and what event kicked them off?\"\n"),
    ("refl", "Reflect",
     "MHPs describing their ability to aid specific symptoms or concerns raised by the client.\n",
     "- \"Reflect\" is limited to reflections of prospective clients' symptoms (anxiety, depression, stress)\n"
     "or clear synonyms thereof (\"sadness\").\n"
     "- \"Reflect\" does not apply to reflections of clients' identities.\n",
     "Below are human-validated examples of \"Reflect\"\n"
     "\"It's clear your anxiety is disrupting your life. Let's do what we can to begin your healing journey.\"\n"
     "\"Depression can be a bear. So sorry to hear of your struggles.\"\n"
     "\"We've seen a lot of stress like yours going around lately, but it can be dealt with <|PII|>.\"\n"),
]

"""Word lists and rewrite tables whose content decides results. Order matters where they are sequences."""

# Contractions, replaced one after the other as plain text.
CONTRACTIONS_UNIFIED_QUORA = (
    ("don't", "do not"), ("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"),
    ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("what's", "what is"), ("that's", "that is"),
)
CONTRACTIONS_UNIFIED_ANTIQUE = CONTRACTIONS_UNIFIED_QUORA[:9]
CONTRACTIONS_QUESTION = (
    *CONTRACTIONS_UNIFIED_QUORA, ("there's", "there is"), ("here's", "here is"), ("where's", "where is"), ("how's", "how is"),
)
CONTRACTIONS_SIMPLE = (
    ("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"),
    ("'d", " would"), ("'m", " am"),
)
CONTRACTIONS_MEDICAL = (
    ("don't", "do not"), ("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'ve", " have"),
    ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("what's", "what is"), ("that's", "that is"), ("there's", "there is"),
    ("it's", "it is"), ("he's", "he is"), ("she's", "she is"), ("doesn't", "does not"), ("isn't", "is not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("haven't", "have not"), ("hasn't", "has not"), ("hadn't", "had not"),
    ("wouldn't", "would not"), ("shouldn't", "should not"), ("couldn't", "could not"), ("mustn't", "must not"),
)
CONTRACTIONS_MEDICAL_TRAINING = (
    *CONTRACTIONS_MEDICAL, ("who's", "who is"), ("where's", "where is"), ("when's", "when is"), ("why's", "why is"),
    ("how's", "how is"), ("here's", "here is"), ("let's", "let us"),
)
CONTRACTIONS_ENHANCED = (*CONTRACTIONS_SIMPLE, ("'s", " is"))

# Question openings, rewritten in this order.
QUESTION_PATTERNS = (
    ("how do i", "how to"), ("how can i", "how to"), ("how should i", "how to"), ("what is the best way to", "how to"),
    ("what are the ways to", "how to"), ("what are some", "what are"), ("what are the", "what are"),
)

# Medical phrases, joined in this order, and synonyms of single tokens.
MEDICAL_PHRASES = (
    ("high blood pressure", "hypertension"), ("blood pressure", "hypertension"), ("heart attack", "cardiac_event"),
    ("chest pain", "chest_pain"), ("back pain", "back_pain"), ("stomach pain", "stomach_pain"), ("head ache", "headache"),
    ("sore throat", "sore_throat"), ("runny nose", "runny_nose"),
)
SYNONYMS_SERVING = {
    "ache": "pain", "aching": "pain", "hurt": "pain", "hurting": "pain", "sore": "pain", "tender": "pain", "discomfort": "pain",
    "illness": "disease", "sickness": "disease", "ailment": "disease",
    "remedy": "treatment", "cure": "treatment", "therapy": "treatment",
    "physician": "doctor", "doc": "doctor", "medic": "doctor",
}
SYNONYMS_TRAINING = {
    "ache": "pain", "aching": "pain", "hurt": "pain", "hurting": "pain", "sore": "pain", "tender": "pain", "discomfort": "pain",
    "soreness": "pain", "throbbing": "pain", "stinging": "pain", "burning": "pain",
    "illness": "disease", "sickness": "disease", "ailment": "disease", "disorder": "condition", "syndrome": "condition", "malady": "disease",
    "remedy": "treatment", "cure": "treatment", "therapy": "treatment",
    "medication": "medicine", "drug": "medicine", "pill": "medicine", "prescription": "medicine",
    "physician": "doctor", "doc": "doctor", "medic": "doctor", "surgeon": "doctor", "specialist": "doctor",
    "swelling": "inflammation", "redness": "inflammation", "infection": "inflammation", "irritation": "inflammation",
    "tummy": "stomach", "belly": "stomach", "gut": "stomach",
    "knee": "joint", "ankle": "joint", "wrist": "joint", "elbow": "joint", "shoulder": "joint", "hip": "joint",
}

# Query expansions, by head.
EXPANSIONS_MEDICAL = {
    "pain": ("ache", "hurt", "sore", "discomfort"), "treatment": ("remedy", "cure", "therapy", "medication"),
    "disease": ("illness", "condition", "disorder", "syndrome"), "doctor": ("physician", "specialist", "medic"),
    "medicine": ("drug", "medication", "pill", "prescription"), "inflammation": ("swelling", "redness", "infection"),
}
EXPANSIONS_ENHANCED = {
    "pain": ("ache", "hurt", "discomfort"), "swelling": ("inflammation", "swollen", "edema"), "cause": ("reason", "why", "lead"),
    "help": ("aid", "assist", "remedy"), "best": ("top", "good", "recommend"), "antique": ("vintage", "old", "ancient", "historical"),
}

# Phrases that are appended as single tokens where they occur.
KEY_PHRASES = (
    "chest pain", "heart attack", "blood pressure", "side effect", "pain relief", "home remedy", "natural cure", "medical condition",
    "antique furniture", "vintage item", "old book", "ancient artifact", "historical piece", "collector item", "rare find",
    "how to", "what is", "why does", "when should", "where can", "what causes", "how much", "how many", "best way",
)
NEGATORS = ("not", "no", "never", "neither", "nor")

# Stop lists.
STOP_SIMPLE = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with".split())
STOP_SERVING = tuple(
    """the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could
    should may might must shall can this that these those i you he she it we they me him her us them my your his its our their""".split()
)
STOP_TRAINING = tuple(
    """the a an and or but in on at to for of with by from as into through during before after above below up down out off over
    under again further then once""".split()
)
STOP_ADVANCED = tuple(
    """a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each
    which she do how their if up out many then them so some her would make like into him time two more very when come may say get
    go no way could my than first been call who oil sit now find long down day did made part over new sound take only little work
    know place year live me back give most after thing our just name good sentence man think great where help through much before
    line right too mean old any same tell boy follow came want show also around form three small set put end why again turn here
    off went number men every found still between mightn being your well without should never does must can cannot might shall am
    i you we us about all were one other use or not""".split()
)
# The widely published English stop list of 179 words, used where no list is given.
STOP_ENGLISH = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
    she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those
    am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)
# Words kept although they are in the stop list.
KEEP_QUESTION = tuple(
    """what when where why who which how can could would should will shall do does did is are was were not no never none nothing
    neither more most less least very quite much many few some any all best better good bad right wrong""".split()
)
KEEP_ANTIQUE = tuple("what when where why who which how can could would should will shall do does did is are was were not no never none nothing neither".split())
KEEP_ENHANCED = tuple(
    """what when where why who which how best worst better good bad first last old new antique vintage ancient modern most more
    less least very much can could should would may might must cause causes effect effects reason reasons help helps prevent
    prevents cure cures make makes use uses need needs pain swelling symptom symptoms""".split()
)

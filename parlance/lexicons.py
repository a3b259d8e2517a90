"""Word lists and patterns that the text signals work with.

Every operator takes its lists as a parameter; the ones here are the defaults. All entries are
fixed values: the results depend on them word for word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Unicode blocks tested for a script, in tie-break order.
SCRIPT_BLOCKS = (
    ("malayalam_script", r"\x{0D00}-\x{0D7F}"),
    ("hindi_script", r"\x{0900}-\x{097F}"),
    ("tamil_script", r"\x{0B80}-\x{0BFF}"),
    ("telugu_script", r"\x{0C00}-\x{0C7F}"),
    ("kannada_script", r"\x{0C80}-\x{0CFF}"),
    ("arabic_script", r"\x{0600}-\x{06FF}"),
)

# Romanised labels that voice messages in a script get.
VOICE_LABELS = (
    ("malayalam_script", "manglish"),
    ("hindi_script", "hinglish"),
    ("tamil_script", "tanglish"),
)

# Romanised Malayalam.
MANGLISH_WORDS = (
    "undu undo aanu aano alla allathe enthaanu enthanu enthokke enthokkeya "
    "kanikku kaanikku kaanikkatte kanikkatte ethraya ethra nokkunnath nokkunath "
    "nokkatte nokkoo cheyyatte cheyyam cheyyuka cheythal parayuu parayu athe "
    "illa alle kootuthal keralathil evide ivide engane enganeya vellom onnum "
    "matte ithu athu njan nammal nammude ningal valare ippol eppo vannu "
    "vannilla kittumo kittum venam venda sahayam tharam ayakkanam ayakkamo "
    "undallo undath cheytholu nokkikoloo evideya aayitt ariyatte ariyamo manasilayi "
    "onnumilla churithar churidhar topundo vilayethra ethrayanu rateethraya kurtiyundo "
    "namaskaram sugamano entha evidunnu kerala kochi calicut kannur thrissur malappuram "
    "kazhinjo varumo ayakkumo edukkatte nokki parayam vegam pathiye angane ingane"
).split()

# Place names in the list above that are no sign of the language.
MANGLISH_PLACES = "kerala kochi calicut kannur thrissur malappuram".split()

# Clothing words in the list above, and the English words that outweigh them.
CLOTHING_WORDS = "churithar churidhar".split()
CLOTHING_ENGLISH_CUES = (
    "only for do you u have is are what show me how much needed need nephew t-shirt shirt").split()

# Romanised Hindi.
HINGLISH_WORDS = (
    "hai hain kya kare kaise kitna kitne chahiye bhai aap aapka aapke "
    "nahi dikhao batao daam kapda accha achha muje mujhe bhejo "
    "kardo milega milegi hoga hogi bolo bataiye paas dijiye shukriya dhanyawad "
    "dekhna kharidna bhejiye pata sahi dupatta kurtiyan kab tak karo bhi toh"
).split()

# Romanised Tamil.
TANGLISH_WORDS = (
    "irukka irukku evvalavu sollunga pannunga enna vanganum "
    "kudunga theriyuma romba illai solren kedaikkuma yenna panreenga "
    "parunga venum kodu annachi engitta epdi eppadi ungalukku kudupingala"
).split()

# Replies too short to carry a language of their own.
SHORT_REPLIES = "ok okay yes no sure fine done s m l xl xxl 3xl hai k kk".split()

# Words that the profile's coarser detector takes as romanised Malayalam.
PROFILE_MANGLISH_WORDS = (
    "undu undo aanu aano alla allathe enthaanu enthanu enthokke enthokkeya "
    "kanikku kaanikku kaanikkatte kanikkatte ethraya ethra nokkunnath nokkunath "
    "nokkatte nokkoo cheyyatte cheyyam cheyyuka cheythal parayuu parayu athe "
    "illa alle kootuthal keralathil evide ivide engane enganeya vellom onnum "
    "matte ithu athu njan nammal nammude ningal valare ippol eppo vannu "
    "vannilla kittumo kittum venam venda sahayam tharam ayakkanam ayakkamo "
    "nalla ishtam undallo undath cheytholu nokkikoloo evideya aayitt"
).split()
PROFILE_ENGLISH_CUES = (
    "only need needed nephew t-shirt shirt what where when why how have deliver shipping price show "
    "collection").split()

# Greetings of the intent router and of the greeting-only test.
ROUTER_GREETINGS = ("hi", "hello", "hey", "good morning", "good evening", "how are you", "who are you")
AGENT_GREETINGS = (
    "hi", "hello", "hey", "hai", "helo", "hlo", "haii", "hii", "hiii",
    "yo", "good morning", "good evening", "good afternoon")

# Phrases that ask for deeper reasoning, and the word count above which any text does.
REASONING_TRIGGERS = (
    "compare", "tradeoff", "trade-off", "architecture", "deep dive", "benchmark",
    "difference between", "step by step", "complex", "evaluate", "why should we")
REASONING_WORDS = 35

# Size patterns, first match wins.
SIZE_PATTERNS = (
    (r"\b(size\s*:?\s*)?(xxxl|3xl)\b", "3XL"),
    (r"\b(size\s*:?\s*)?(xxl|2xl)\b", "XXL"),
    (r"\b(size\s*:?\s*)?(xl)\b", "XL"),
    (r"\b(size\s*:?\s*)?(large)\b", "L"),
    (r"\b(size\s*:?\s*)?(medium)\b", "M"),
    (r"\b(size\s*:?\s*)?(small)\b", "S"),
    (r"\b(size\s*:?\s*)?(xs)\b", "XS"),
)
# Fixed value: single letters need the word "size" beside them, so that "I'm" is no M.
SIZE_LETTER_PATTERN = (
    r"(?<![a-zA-Z'])\b(size\s+m|m\s+size|size\s+l|l\s+size|size\s+s|s\s+size|size\s+xl|xl\s+size)\b")

# Fabrics and places, in match order.
FABRICS = ("cotton", "rayon", "chiffon", "silk", "linen", "georgette")
LOCATIONS = (
    "kochi", "cochin", "ernakulam", "calicut", "kozhikode",
    "trivandrum", "thiruvananthapuram", "thrissur", "trichur",
    "kannur", "kollam", "quilon", "kottayam", "palakkad",
    "malappuram", "alappuzha", "alleppey", "wayanad", "kasaragod",
    "idukki", "pathanamthitta")

# Lifecycle stages in match order, with their tag and keywords.
STAGES = (
    ("Ready to Order", "High Intent", (
        "order", "book", "gpay", "google pay", "phonepe", "upi",
        "pay", "buy", "purchase", "address tharam", "send address",
        "account details", "bank transfer", "confirm")),
    ("Support", "Post-Purchase Support", (
        "tracking", "courier", "status", "dispatch", "delivery eppo",
        "reach", "delay", "not received", "item vannilla", "complaint")),
    ("Browsing", "Shopper", (
        "model", "models", "photos", "pics", "color", "colours",
        "price", "rate", "cost", "churidar", "collection", "stock",
        "available", "catalogue", "catalog")),
)

# Questions about stored personal data.
MEMORY_PROBES = (
    "ormayundo", "ormund", "ormundo", "njan aaranu", "who am i", "remember me",
    "remember my", "you remember", "yaad hai", "pehechana", "pata hai mera",
    "my size", "mera size", "ente size", "my order", "pichla order", "pandu medicha",
    "my address", "ente address", "phone number", "my phone", "tracking id",
    "tracking number", "favourite color", "favorite color", "favorite fabric",
    "complaint", "kya mangwaya tha", "entha medichathu", "ente peru")

# Requests for a spoken reply.
VOICE_REPLY_TRIGGERS = (
    "voice note", "voice message", "audio reply", "send audio", "voice reply",
    "voice mail", "speak to me", "voice il", "voice aayi", "parayumo", "bolke",
    "batao", "solli", "anupunga", "audio aayi", "voiceil", "bolke batao")

# Decorative signs dropped from replies, and the languages that need nothing else.
EMOJI_CLASS = r"[\x{2728}\x{1F338}\x{1F4AB}\x{1F31F}\x{1F33C}\x{1F389}]+"
PLAIN_LANGUAGES = ("english", "hindi_script", "malayalam_script", "tamil_script", "telugu_script")

# Latin spellings of Malayalam letters; longer keys are replaced first.
MALAYALAM_TO_LATIN = (
    ("ക്കേണ്ട", "kkenda"), ("േണ്ട", "enda"), ("ണ്ട", "nda"), ("ത്ത", "ttha"), ("ച്ച", "ccha"),
    ("ല്ല", "lla"), ("ക്ക", "kka"), ("ന്ന", "nna"), ("മ്മ", "mma"), ("റ്റ", "tta"), ("ഞ", "nja"),
    ("ങ്ങ", "nga"), ("ാ", "a"), ("ി", "i"), ("ീ", "ee"), ("ു", "u"), ("ൂ", "oo"), ("െ", "e"),
    ("േ", "e"), ("്", ""), ("ം", "m"), ("ൽ", "l"), ("ർ", "r"), ("ൻ", "n"), ("ണ്", "n"), ("ണ", "na"),
    ("ന", "na"), ("മ", "ma"), ("യ", "ya"), ("ര", "ra"), ("ല", "la"), ("വ", "va"), ("ശ", "sha"),
    ("ഷ", "sha"), ("സ", "sa"), ("ഹ", "ha"), ("ള", "la"), ("ഴ", "zha"), ("റ", "ra"), ("ക", "ka"),
    ("ഗ", "ga"), ("ച", "cha"), ("ജ", "ja"), ("ട", "ta"), ("ഡ", "da"), ("ത", "tha"), ("ദ", "da"),
    ("പ", "pa"), ("ബ", "ba"),
)

# Hyphen rewrites in order (pattern, replacement, ignore case).
HYPHEN_REWRITES = (
    (r"\b([A-Za-z]+)-(te|nte|inte)\b", "$1 inte", True),
    (r"\bKerala-il\b", "Kerala yil", True),
    (r"\b([A-Za-z]+)-(il|yil)\b", "$1 il", True),
    (r"\b([A-Za-z]+)-(kku|ku)\b", "$1kku", True),
    (r"\b([A-Za-z]+)-(anu|aanu|alla)\b", "$1 $2", True),
    (r"([A-Za-z]{2,})-([A-Za-z]{2,})", "$1 $2", False),
)

# A mention of size S in old turns and what stands in for it.
SIZE_MENTION = (r"\b(size\s*S|S\s*size)\b", "sizes S-XXL")

# Words that are no topic, the characters stripped around words, and what a profile says.
TOPIC_STOPWORDS = "the a an is in it to of for and or on what how why i you".split()
TOPIC_STRIP = "?,.!"
TOPIC_FALLBACK = "General Inquiries"


@dataclass(frozen=True)
class LanguageLexicon:
    """Lists of the language ladder. ``families`` are three (label, words) pairs in vote order:
    the second wins over the first only with more votes, the third over the first likewise."""

    families: tuple = (("manglish", tuple(w for w in MANGLISH_WORDS if w not in MANGLISH_PLACES)),
                       ("hinglish", tuple(HINGLISH_WORDS)), ("tanglish", tuple(TANGLISH_WORDS)))
    clothing: tuple = tuple(CLOTHING_WORDS)
    clothing_cues: tuple = tuple(CLOTHING_ENGLISH_CUES)
    short_replies: tuple = tuple(SHORT_REPLIES)
    scripts: tuple = SCRIPT_BLOCKS
    voice_labels: tuple = VOICE_LABELS
    default: str = "english"


@dataclass(frozen=True)
class ProfileLexicon:
    """Lists of the profile signals."""

    size_patterns: tuple = SIZE_PATTERNS
    size_letter_pattern: str = SIZE_LETTER_PATTERN
    fabrics: tuple = FABRICS
    locations: tuple = LOCATIONS
    stages: tuple = STAGES
    romanised: tuple = tuple(PROFILE_MANGLISH_WORDS)
    romanised_label: str = "manglish"
    script_label: str = "malayalam_script"
    script_block: str = SCRIPT_BLOCKS[0][1]
    english_cues: tuple = tuple(PROFILE_ENGLISH_CUES)
    english_label: str = "english"


@dataclass(frozen=True)
class RouterLexicon:
    greetings: tuple = ROUTER_GREETINGS
    triggers: tuple = REASONING_TRIGGERS
    max_words: int = REASONING_WORDS
    tiers: dict = field(default_factory=lambda: {"CHIT_CHAT": "fast", "RAG_QUERY": "fast", "DEEP_REASONING": "deep"})

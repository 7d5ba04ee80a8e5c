"""Regular expressions and word lists of the text classifiers.

Everything in this file is a fixed value: results depend on each of them exactly. Most are matched without regard to
case; grainmill.functions.text gives the flags.
"""

from __future__ import annotations


# Wording that a language model leaks; words that mark a language in the cleaner.
META_LANGUAGE = r"\b(as a user|generate an example|here is an example|training data|llm|gpt|claude|sample message|example message|annotation note|annotator)\b"
CLEAN_HINDI = r"\b(hai|hun|hain|meri|mujhe|main|aur|lekin|kya|nahi|bhi|toh|bahut|ghar|mummy|papa|chahta|chahti|karna|karun|izzat|shaadi|rishta|yaar|dost|matlab|kyunki|isliye|phir|accha|theek|hota|lagta|rehta)\b"
CLEAN_ENGLISH = r"\b(the|a|an|is|are|my|your|we|they|this|and|but|not|feel|think|want|been|have|I'm|it's|don't|can't|won't)\b"

# Signals of the label validator.
LABEL_CRISIS = r"\b(end my life|end it all|kill myself|want to die|don't want to live|suicidal|no reason to live|can't go on|hurt myself|cut myself|thinking about suicide|thinking of ending|overdose on|take my life|marna chahta|mar jaun|zindagi nahi chahiye|khatam kar lun)\b"
LABEL_METAPHOR = r"\b(kill(ing)?\s+(it|this|exam|test|interview|presentation)|dying\s+of\s+(laughter|boredom|embarrassment|hunger)|dead\s+(tired|serious|inside\s+jokes)|murder(ing)?\s+(it|this)|i\s+could\s+kill\s+for|this\s+is\s+killing\s+me\s+(with\s+)?(laughter|boredom))\b"
LABEL_DISTRESS = r"\b(can't take it|breaking down|falling apart|losing my mind|completely lost|nothing matters|what's the point|toot gaya|toot raha|haar gaya|haar raha|roke nahi)\b"

# Quality patterns of the seed set.
SEED_METAPHOR = r"kill(ing)?\s+(it|this|exam|test)|dying\s+of\s+laughter|dead\s+(tired|serious)|murder(ing)?\s+(it|this)"
SEED_UNSAFE = r"(step\s+by\s+step|instructions\s+for).{0,50}(kill|harm|suicide|overdose)|took\s+\d+\s+pills"
SEED_TEMPLATED = r"(write\s+a\s+message|generate\s+an\s+example|here\s+is\s+an\s+example|as\s+a\s+user|training\s+data|annotation|llm|gpt|claude)"

# The risk cascade, in order of matching.
RISK_METAPHORS = [
    r"kill(ing)?\s+(it|this|that|the|my|these|those)\s+(exam|test|presentation|interview|quiz|viva|class|project|assignment|game|match)",
    r"dying\s+of\s+(laughter|boredom|excitement|hunger|thirst|cuteness|embarrassment)",
    r"dead\s+(tired|serious|cert|honest|broke)",
    r"murder(ing)?\s+(it|this|the|that)",
    r"i('m| am)\s+(literally\s+|figuratively\s+)?dying\s+(lol|lmao|haha|😂|🤣)",
    r"killing\s+me\s+(softly|gently)?$",
    r"i\s+(could|would)\s+(literally\s+|figuratively\s+)?kill\s+for",
    r"suicide\s+(squad|mission|door|note\s+joke|meme)",
    r"want\s+to\s+(shoot|kill)\s+(myself\s+)?(for|because\s+of)?\s+(fun|laughter|embarrassment)",
    r"killing\s+it\s+at",
]
RISK_TIER_5 = [
    r"\balready\s+took\s+(pills|tablets|medicines|drugs)\b",
    r"\balready\s+hurt\s+(myself|yourself)\b",
    r"\bi('m| am)\s+(currently\s+|right\s+now\s+|already\s+)?(bleeding|cutting\s+myself|hurting\s+myself)\b",
    r"\bdoing\s+it\s+tonight\b",
    r"\bi\s+have\s+a\s+(plan|method)\b",
    r"\bgoli\s+le\s+lunga\b",
    r"\babhi\s+kuch\s+kar\s+lunga\b",
    r"\bbleeding\s*(now|right\s+now|already)?\b",
    r"\btook\s+(the\s+)?pills\b",
    r"\bpehle\s+se\s+kar\s+liya\b",
]
RISK_TIER_4 = [
    r"\bi\s+want\s+to\s+(hurt|harm|kill|end)\s+myself\b",
    r"\bi('m| am)\s+going\s+to\s+(hurt|harm|kill|end)\s+myself\b",
    r"\bwant\s+to\s+die\b",
    r"\bkill\s+myself\b",
    r"\bend\s+my\s+life\b",
    r"\bsuicidal\b",
    r"\bself[.\s-]?harm(ing)?\b",
    r"\bcutting\s+(myself|my\s+(arms?|wrists?|legs?|skin))\b",
    r"\bmar\s+jan(a|e)\s+chah(ta|ti)\s+(hun|hai|hoon)\b",
    r"\bmar\s+jaana\s+chahti\s+hun\b",
    r"\bkhud\s+ko\s+hurt\s+(karna|kar)\s+(chahta|chahti)\b",
    r"\bnahi\s+rahunga\b",
    r"\bzindagi\s+khatam\s+(kar\s+dunga|karna\s+chahta)\b",
    r"\bjaan\s+de\s+dunga\b",
    r"\bjaan\s+dena\s+chahta\b",
    r"\bkhud\s+ko\s+khatam\s+karna\b",
    r"\bmujhe\s+marr?\s+jana\s+chahi?ye\b",
    r"\bmai(n)?\s+marr?\s+jaana\s+chahta\b",
    r"\b(try|attempt|thinking\s+of|consider)\s+(a\s+)?suicide\b",
    r"\bsuicide\s+(attempt|try|kar\s+leta|kar\s+leti)\b",
    r"\bkhatam\s+kar\s+leta\s+hun\b",
    r"\bkhatam\s+kar\s+leti\s+hun\b",
    r"\bshall\s+i\s+(try|attempt|do)\s+(a\s+)?suicide\b",
    r"\bshould\s+i\s+(try|attempt|do)\s+(a\s+)?suicide\b",
    r"\bcan\s+i\s+(try|attempt|do)\s+(a\s+)?suicide\b",
]
RISK_TIER_3 = [
    r"\bdon'?t\s+want\s+to\s+(live|be\s+here|exist|go\s+on)\b",
    r"\bno\s+(point|reason|purpose)\s+(in\s+|to\s+)?(living|going\s+on|trying|anything)\b",
    r"\bcan'?t\s+go\s+on\b",
    r"\bwant\s+it\s+all\s+to\s+stop\b",
    r"\bwish\s+(i\s+were|i\s+was|i'?d)\s+(dead|never\s+born|not\s+here|gone)\b",
    r"\bkhatam\s+karna\s+chahta\s+(hun|hun\s+main)\b",
    r"\bnahi\s+rehna\s+chahta\b",
    r"\bjeene\s+ka\s+mann\s+nahi\b",
    r"\bsab\s+khatam\b",
    r"\bthak\s+gaya\s+(hun|hoon)\s+(zindagi\s+se|sab\s+se|sab\s+kuch\s+se)\b",
    r"\bfinished\s+with\s+everything\b",
    r"\bnothing\s+left\s+(to\s+live\s+for|for\s+me)\b",
    r"\beverything\s+feels\s+(hopeless|pointless|meaningless)\b",
    r"\bdon'?t\s+see\s+the\s+point\s+anymore\b",
    r"\bjust\s+want\s+to\s+disappear\b",
    r"\bwish\s+i\s+could\s+disappear\b",
    r"\bmarna\s+chahta\s+hun\b",
    r"\bjina\s+nahi\s+chahta\b",
    r"\bfeel\s+(so\s+)?(hopeless|worthless|pointless)\b",
    r"\blife\s+(is\s+)?(not\s+worth|meaningless|pointless)\b",
]
RISK_TIER_2 = [
    r"\b(shall|should|can|could|will|would)\s+i\s+(try|do|commit|attempt)?\s*(a\s+)?(homicide|murder|kill\s+(them|him|her|my\s+family|my\s+parents|my\s+father|my\s+mother|everyone))\b",
    r"\bkill\s+(them|him|her|my\s+family|my\s+parents|my\s+father|my\s+mother|everyone)\b",
    r"\b(want\s+to|going\s+to|thinking\s+of)\s+(kill|murder|hurt)\s+(them|him|her|my\s+(family|parents|father|mother|husband|wife))\b",
    r"\bhomicide\b",
    r"\bmurder\s+(them|him|her|my|someone)\b",
    r"\b(will|would|might|going\s+to)\s+kill\s+me\b",
    r"\b(father|dad|mother|mum|maa|papa|husband|in.?laws?)\s+(will|would|might|going\s+to)\s+kill\s+me\b",
    r"\bthey('?ll|\s+will)\s+kill\s+me\b",
    r"\bwoh\s+mujhe\s+maar\s+(denge|dalenge)\b",
    r"\bmujhe\s+maar\s+(denge|dalenge|dera)\b",
    r"\b(getting|being|forced)\s+(married|to\s+marry)\s+(tomorrow|today|next\s+week|soon|against)\b",
    r"\barranged\s+marriage.{0,40}(forced|don'?t\s+want|against\s+my\s+will|not\s+ready)\b",
    r"\bforced\s+(to\s+)?(marry|marriage|shaadi|wedding)\b",
    r"\bdon'?t\s+want\s+to\s+(get\s+)?marry\b",
    r"\b(married|marrying)\s+against\s+my\s+will\b",
    r"\bchild\s+(marriage|bride|groom)\b",
    r"\bmarrying\s+a\s+\d+\s+year.?old\b",
    r"\bmarried\s+to\s+a\s+\d+\s+year.?old\b",
    r"\b(shaadi|byah|vivah).{0,30}(kal|aaj|parso|kal\s+hai|ho\s+rahi\s+hai)\b",
    r"\b(physically|sexually)\s+(abused|abusing|hurt)\s+(by|me)\b",
    r"\bhe'?s?\s+(beating|hitting|hurting)\s+me\b",
    r"\b(locked|trapped|stuck)\s+(in|inside|at)\s+(my\s+)?(home|house|room)\b",
    r"\b(can'?t|cannot)\s+(leave|escape|get\s+out)\b.{0,40}\b(home|house|family|them)\b",
    r"\bnot\s+(allowed|permitted)\s+to\s+(go\s+out|leave|study|work)\b",
    r"\bgharon\s+se\s+bahar\s+nahi\s+(nikalne\s+dete|aane\s+dete)\b",
    r"\bi'?m\s+(only\s+)?(1[0-7]|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen)\s+years?\s+old.{0,60}(marry|marriage|abuse|hurt|kill|escape|run)\b",
    r"\b(1[0-7])\s+years?\s+old.{0,60}(forced|married|abuse|escape|run\s+away)\b",
]

# Mention of a minor; the second list is the narrower one of the score resolver.
RISK_MINOR = r"\b(1[0-7]|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen)\s+years?\s+old\b|\bminor\b|\bchild\b"
SCORE_MINOR = r"\b(1[0-7]|fifteen|sixteen|seventeen|fourteen|thirteen|twelve|eleven|ten)\s+years?\s+old\b"

# Greetings.
GREETING_OPENER = r"^(hi+|hello+|hey+|heyy+|hii+|namaste|namaskar|howdy|sup|good\s+(morning|afternoon|evening|night)|wassup|yo\s|greetings)\b"
GREETING_EXACT = r"^(aur\s+(bhai|yaar|dost|ji)?\s*[!?.]?|kya\s+haal(\s+hai)?|kaise\s+ho|kaise\s+hain|what'?s?\s+up|mast\s+hun[!.]*|theek\s+hun[!.]*|sab\s+badhiya[!.]*|all\s+good[!.]*|bas\s+aisa\s+hi[!.]*|chill\s+hun[!.]*|mazey\s+mein[!.]*|mai\s+to\s+mast\s+hoon[!.]*|main\s+mast\s+hun[!.]*|mast\s+hoon[!.]*|badhiya\s+hoon[!.]*|ekdum\s+mast[!.]*|kuch\s+nahi\s+bas[!.]*|bas\s+yun\s+hi[!.]*)[\s!?.]*$"
GREETING_CHECK_IN = r"^(i'?m?\s+(fine|good|great|okay|ok|alright|doing\s+well|doing\s+fine)|i\s+am\s+(fine|good|okay)|mai\s+to\s+mast|main\s+theek|sab\s+theek|mast\s+hoon|badhiya\s+hoon|ekdum\s+badhiya|khush\s+hun|bahut\s+achha|life\s+is\s+good)[\s!?.]*$"

# Signals of intents and emotions.
FAMILY = r"\b(maa|papa|parents|family|ghar|mummy|didi|doctor\s+banu|engineer|ghar\s+wale|gharwale|beta|beti|expectations|career\s+pressure|ghar\s+waalon|gharwaalon|bacche|baap|maa\s+baap|ma\s+baap|mere\s+bhai|chota\s+bhai|bade\s+bhai|bhai\s+ne|bhai\s+ko)\b"
ACADEMIC = r"\b(JEE|NEET|UPSC|exam|marks|result|college|rank|percentile|boards|fail|grade|score|studies|padhai|coaching|topper|AIIMS|IIT|12th|10th|fees|admission|entrance|competitive)\b"
MARRIAGE = r"\b(shaadi|marriage|rishta|arranged|inter.?caste|dowry|divorce|love\s+marriage|wedding|byah|vivah|shadi)\b"
IDENTITY = r"\b(gay|queer|transgender|non.?binary|LGBTQ|atheist|religion|faith|sexuality|identity|coming\s+out|double\s+life|bisexual|lesbian|dharm|aastha|nafs)\b"
FINANCIAL = r"\b(loan|EMI|scholarship|job|income|money|broke|debt|afford|remittance|breadwinner|support\s+family|paisa|paise|gareeb|karz|rozgaar|naukri|business)\b"
SOCIAL = r"\b(log\s+kya\s+kahenge|izzat|reputation|society|relatives|neighbours|community|honour|ashamed|judge|gossip|log\s+sochenge|padosi|rishtedaar|samaj|log\s+dekhenge)\b"
POSITIVE = r"\b(got\s+the\s+job|cleared|passed|scholarship|promotion|happy|excited|finally|achievement|congrats|success|made\s+it|khushi|khush|mila|mil\s+gaya|ho\s+gaya|qualify)\b"
ADVICE = r"\b(what\s+should\s+I\s+do|kya\s+karun|how\s+do\s+I|please\s+help|suggest|advice|tell\s+me|guide\s+me|koi\s+solution|batao|kya\s+karna\s+chahiye|samjhao)\b"
VALIDATION = r"\b(am\s+I\s+overreacting|is\s+this\s+normal|am\s+I\s+wrong|sahi\s+hun|theek\s+hun|kya\s+main|do\s+you\s+think\s+I\s+should|galat\s+hun|sahi\s+kar\s+raha|behave\s+kar\s+raha)\b"
ANXIETY = r"\b(worried|anxious|nervous|scared|fear|darr|tension|pressure|stress|panic|overthinking|ghabrahat|dara|dar\s+lag|chinta)\b"
GUILT = r"\b(guilt|guilty|mere\s+wajah\s+se|meri\s+galti|I\s+feel\s+bad|disappointing|let\s+them\s+down|sharm|paap|kasoor\s+mera)\b"
LOVE = r"\b(love\s+them|pyaar\s+karta|care\s+karta|chahta\s+hun\s+unhe|unse\s+pyaar|unka\s+bura\s+nahi\s+chahta|maa\s+se\s+pyaar|family\s+ko\s+love|I\s+love\s+my|apno\s+se\s+pyaar)\b"
ANGER = r"\b(angry|frustrated|furious|gusse|hate|irritated|fed\s+up|enough|bhot\s+gussa|bahut\s+gussa|naraaz|krodh|nafrat)\b"
HOPELESS = r"\b(hopeless|pointless|no\s+point|give\s+up|can't\s+anymore|exhausted|thak\s+gaya|thak\s+gayi|haarna|haar\s+gaya|haar\s+jaana|haarna\s+chahta|haarna\s+chahti|nirasha|haar\s+maan|umeed\s+nahi|koi\s+umeed|sab\s+khatam|khatam\s+ho\s+gaya|bas\s+ho\s+gaya)\b"
SHAME = r"\b(ashamed|sharam|embarrassed|humiliated|sharminda|sar\s+nahi\s+utha|muh\s+nahi\s+dikha)\b"
LONELINESS = r"\b(lonely|alone|akela|akeli|no\s+one|koi\s+nahi|akelapan|isolated|no\s+friends|dost\s+nahi)\b"
OVERWHELM = r"\b(overwhelmed|too\s+much|bahut\s+zyada|sambhal\s+nahi|handle\s+nahi|cope\s+nahi|sab\s+kuch\s+ek\s+saath|itna\s+sab|bore\s+ho\s+gayi)\b"
STIGMA = r"\b(not\s+crazy|not\s+mental|not\s+sick|just\s+stressed|don't\s+need\s+therapy|not\s+a\s+therapy|not\s+a\s+mental|paagal\s+nahi\s+hun|pagal\s+nahi|mental\s+nahi|main\s+paagal\s+thodi\s+hun|mujhe\s+psychiatrist)\b"
NEGATIVE_WORDS = r"\b(stress|pressure|worried|anxious|sad|fail|bad|hard|difficult|cant|can't|nahi|hopeless|terrible|awful|worst|dard|takleef|mushkil|pareshaan|bura|zyada|problem|tense|dar)\b"
POSITIVE_WORDS = r"\b(happy|good|great|excited|passed|cleared|success|wonderful|achha|theek|sahi|love|khushi|mila|appreciate|grateful|positive|better|improve|achhe|mast|badhiya|mazey)\b"

# Idioms, and those matched with regard to case.
IDIOMS = {
    "log_kya_kahenge": r"log\s+kya\s+kahenge|log\s+sochenge|log\s+dekhenge",
    "izzat": r"\bizzat\b",
    "ghar_ki_izzat": r"ghar\s+ki\s+izzat|ghar\s+ka\s+naam",
    "beta_padh_le": r"beta\s+padh\s+le|beta\s+pehle\s+padh|padhai\s+pe\s+dhyan",
    "sab_theek_ho_jayega": r"sab\s+theek\s+ho\s+jayega|sab\s+thik\s+ho\s+jayega",
    "hamare_zamane_mein": r"hamare\s+zamane\s+mein|hamare\s+time\s+mein",
    "JEE": r"\bJEE\b",
    "NEET": r"\bNEET\b",
    "arranged_marriage": r"arranged\s+marriage|arranged\s+shaadi|rishta\s+dhoondhna",
}
CASED_IDIOMS = ("JEE", "NEET")

# Words that mark mixed Hindi and English in the detector; roles and persons.
MIXED_WORDS = [
    "hun", "hai", "hain", "tha", "thi", "the", "meri", "mera", "mujhe", "main", "aur", "par", "lekin", "kyun", "kya", "nahi", "bhi", "toh", "abhi",
    "bahut", "ghar", "mummy", "papa", "chahta", "chahti", "karna", "karun", "izzat", "shaadi", "rishta", "yaar", "bhai", "didi", "samajh", "lagta",
    "sunke", "kitna", "woh", "agar", "sirf", "unhe", "sabse", "mast", "theek", "badhiya", "mazey", "chill",
]
ROLES = ["doctor", "engineer", "lawyer", "IAS", "IPS", "teacher", "artist", "MBA", "CA", "professor", "government", "civil servant"]
PERSONS = ["maa", "papa", "mummy", "dad", "didi", "nani", "dadi", "dada", "nana", "chacha", "chachi", "mausi", "mama"]

# Openers without content in a reply; fields of its metadata.
HOLLOW_OPENER = r"^(absolutely[,!]?|great question[!]?|of course[!]?|sure[!]?|certainly[!]?|definitely[!]?|that'?s great[!]?|great[!]?|wow[!]?|awesome[!]?|i see[!.]?|that makes sense[!.]?|i hear you[!.]?)\s*"
META_FIELDS = ["emotion", "intent", "stressor", "urgency", "risk", "strategy"]

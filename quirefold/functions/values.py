"""Word lists, patterns and constants that results depend on."""

# Starts of lines that repeat an instruction (case doesn't count).
LEAKAGE_STARTS = (
    "from the image",
    "output only",
    "output the",
    "print only",
    "read (all )?text",
    "text block",
    "do not (use|write|repeat|include|mention)",
    "preserve line",
    "the (text|document) may",
    "the image (shows|contains|depicts)",
    "extract all text",
    "OCR with grounding",
    "bounding box",
)

# Phrases by which a whole text repeats its instructions (case doesn't count).
LEAKAGE_PHRASES = (
    "do not use",
    "do not write",
    "do not repeat",
    "extract all text",
    "bounding box",
    "OCR with grounding",
    "from the image",
    "print only",
    "output only",
)

# What counts as mathematics, code and tables.
MATH = (
    r"\\(?:frac|sum|int|sqrt|lim|prod|partial|infty|alpha|beta|gamma|delta|sigma|theta|lambda|mu|pi|omega)",
    r"[_^]\{[^}]*\}",
    r"\$[^$]+\$",
    r"\\(?:left|right|begin|end)\{",
    "[≤≥≠±∑∫∏√∞∂∇×÷∈∉⊂⊃∪∩]",
)
CODE = (
    r"(?:^|\s)(?:def|class|import|from|return|elif|yield|async|await)\s+",
    r"(?:function|const|let|var|=>|===|!==)\s*",
    r"(?:public|private|protected|static|void)\s+",
    r"^\s{4,}(?:return|if|for|while|try|except|raise)\s+",
    r"[{}();]\s*$",
    r"^\s*#\s*(?:include|define|ifdef|ifndef|pragma)",
    r"(?:print|println|console\.log|System\.out)\s*\(",
    r"(?:SELECT|FROM|WHERE|INSERT|UPDATE|DELETE|JOIN|CREATE|ALTER|DROP)\s+",
    r"^\s*(?:self\.|cls\.|this\.)",
    "(?:__init__|__main__|__name__)",
)
TABLE = (
    r"\t[^\t]+\t",
    r"\|[^|]+\|[^|]+\|",
    r"[-─━]{3,}\s*[-─━]{3,}",
    r"^\s*\d+\s{3,}\S+\s{3,}",
)

# Markers of institutions, qualifications and titles.
PROPER_NOUNS = (
    "주식회사", "재단법인", "사단법인", "한국", "대한민국", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종",
    "대학교", "고등학교", "중학교", "초등학교", "연구원", "연구소", "진흥원",
    "기사", "기능사", "산업기사", "기술사", "자격증",
    "교수", "박사", "석사", "학사",
)

# Starts by which a correction talks about itself.
BAD_CORRECTION_STARTS = ("교정된", "수정된", "다음은", "오타를", "오류를")
CORRECTED_HEADER = r"(교정된\s*텍스트|검증[·\s]*교정된\s*텍스트|corrected\s*text)\s*[:：]\s*\n?"
EXPLANATIONS = (
    r"^(다음은|아래는|위 텍스트에서|교정\s*사항|변경\s*사항).*$",
    r"^(주요\s*교정|수정\s*내용|참고)[:：].*$",
    r"^\d+\.\s*(.*?→.*?)$",
)

# The characters that end a text which isn't cut off.
TERMINATORS = ".?!다요음함됨임것수등0123456789①②③④⑤⑥⑦⑧⑨⑩)]\""
# A block of a recogniser's answer (kind and corners, 0 to 999), and one whose first mark is missing.
GROUNDED_BLOCK = r"<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>\[\[(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\]\]<\|/det\|>"
GROUNDED_START = r"^([\w_]+)<\|/ref\|>\s*<\|det\|>\[\[(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\]\]<\|/det\|>"

# The delimiters of formulas.
MATH_REGION = r"\$\$[\s\S]*?\$\$|\$[^$\n]+?\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]"

# Of HTML tables what becomes a tab, what a line break, and what goes (case doesn't count).
CELL_BOUNDARY = r"</td>\s*<td[^>]*>"
ROW_END = "</tr>"
TABLE_TAGS = r"</?(?:table|tr|td|tbody|thead|th)[^>]*>"

# Marks in a recognised line, in the order in which they go: of the recogniser, its coordinates, tags, those at a line's start, in pairs, at a table row's ends, and symbols.
RECOGNISER_MARKS = r"<\|(?:ref|/ref|det|/det|grounding|User|Assistant)\|>:?"
COORDINATES = r"\[\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]\]"
TAGS = "<[^>]+>"
LINE_START_MARKS = r"^(\s*)(#{1,6}\s+|`{3}|>\s*|-\s+)"
PAIRED_MARKS = r"(\*{1,2}|_{1,2}|`)(.*?)\1"
ROW_END_BARS = r"^\s*\||\|\s*$"
SYMBOLS = "[\u2190-\u21ff\u2500-\u257f\u25a0-\u25ff\u2600-\u26ff\u2700-\u27bf]"

# Marks of a part of an answer in which a model thinks (case doesn't count), and of characters that file names can't have.
THOUGHTS = r"<think>[\s\S]*?</think>\s*"
RESERVED = r'[<>:"/\\|?*\x00-\x1f]'

# Formula commands.
DOUBLED_COMMANDS = ("frac", "sum", "int", "prod", "sqrt", "alpha", "beta", "gamma", "delta", "theta", "pi", "sigma", "lambda", "mu", "infty", "lim", "log", "sin", "cos", "tan")
SUBSCRIPT_COMMANDS = ("sum", "prod", "int", "lim", "min", "max", "inf", "sup", "bigcup", "bigcap", "bigoplus")

# A misread syllable and the right one.
CONFUSIONS = {
    "둔": "둡", "둘": "둡", "점": "첨", "충": "층", "홀": "풀", "각": "콕", "백": "빅", "핵": "과", "작": "직", "정": "명", "직": "확",
    "빵": "빅", "빛": "빅", "맥": "망", "결": "검", "뉴": "듀", "폴": "필", "곡": "끝", "든": "듀", "문": "온", "혁": "험", "운": "윤",
    "화": "희", "황": "흥", "포": "필", "풀": "총", "학": "핵", "네": "데", "텍": "데", "텐": "데", "택": "데", "떼": "듀", "꼭": "끝",
}
# Words replaced without a dictionary, in this order.
DIRECT_WORDS = {
    "빵테이터": "빅데이터",
    "빵데이터": "빅데이터",
    "빅테이터": "빅데이터",
    "빛테이터": "빅데이터",
    "빅택이터": "빅데이터",
    "빅텍이터": "빅데이터",
    "빅텐이터": "빅데이터",
    "과내기": "끝내기",
    "신업": "산업",
}
# Particles and endings in the order in which they are tried.
PARTICLES = (
    "에서는", "으로는", "에서의", "으로의", "에서도", "으로도", "이라는", "이라고", "이라면", "이었다", "이라서",
    "에서", "으로", "부터", "까지", "에게", "한테", "처럼", "보다", "라는", "라고", "라면", "이다", "이고", "이나", "이란",
    "에는", "에도", "에의", "와의", "과의", "의한",
    "의", "를", "을", "에", "와", "과", "도", "는", "은", "이", "가", "로", "서", "며", "고", "나", "만", "든", "등",
)
# Numbers of vowels, initials and finals that are taken for each other.
VOWELS = ((8, 13), (4, 0), (18, 4), (18, 13), (20, 1), (1, 7), (6, 4))
INITIALS = ((15, 0), (6, 12), (3, 2), (16, 3))
FINALS = ((17, 8), (17, 4), (16, 21), (8, 16), (8, 4), (1, 21), (0, 21), (4, 0), (1, 16))
# The characters between words.
DELIMITERS = r"""[\s\.,;:!?\(\)\[\]{}<>「」『』【】"'·\-/=+×÷→←]"""

# Error codes and whether work can go on after them.
ERRORS = {
    "E001": "the file can't be opened", "E002": "the file doesn't exist", "E003": "the file has no content", "E010": "the model can't be fetched",
    "E011": "the model's files are damaged", "E012": "the model can't be loaded", "E013": "the framework is missing", "E020": "the page failed",
    "E021": "the page took too long", "E030": "the output can't be made", "E031": "the disk is full", "E040": "memory is short",
    "E041": "memory is exhausted", "E050": "a package is missing", "E051": "the platform isn't supported", "E060": "the number of volumes is wrong", "E061": "splitting failed",
}
RECOVERABLE = ("E010", "E020", "E021", "E040")

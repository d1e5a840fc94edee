"""Word lists, patterns and numbers that results depend on."""

# CJK runs (kana, ideographs with extension A and compatibility forms, Hangul) and Latin words.
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7af]"
WORD = "[a-z0-9]+(?:[-_.'][a-z0-9]+)*"
# Characters that a prompt estimate charges one token each (CJK punctuation and full-width forms too).
CJK_CHARGED = "[\\u3000-\\u303f\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff\\uff00-\\uffef]"
# BM25, fusion, re-ranking and context.
K1, B, RRF_K, DEDUPE, ALPHA, BETA, GAMMA, CONTEXT_CHARS = 1.2, 0.75, 60, 0.9, 0.7, 0.2, 0.1, 12000
TOP_K, CANDIDATES = 5, 30
# Chunks.
CHUNK_SIZE, CHUNK_OVERLAP, LEAST_CHUNK = 512, 50, 80
CJK_TERMINATORS, LATIN_TERMINATORS, CLOSING_MARKS = "。！？；…", ".!?", "」』）〉》”’\"')]"
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "vs", "Fig", "No", "Vol", "Inc", "Ltd", "Approx", "cf")
# Lines that are furniture, matched as a whole and in any case.
NOISE_LINES = (
    r"^cookie policy$",
    r"^privacy policy$",
    r"^terms of (service|use)$",
    r"^accept (all )?cookies$",
    r"^we use cookies\b.*",
    r"^(share|tweet|print|email) this\b.*",
    r"^(read|edit|view history|view source)$",
    r"^jump to (content|navigation|search)$",
    r"^\[?edit\]?$",
    r"^\d+(\.\d+)*$",
    r"^\^.*",
    r"^retrieved \d",
    r"^（?原始內容存檔於.*",
)
# Marks of a bibliography entry, in cleaning and in evaluation.
CITATION_MARKS = ("doi:", "arxiv:", "isbn", "issn", "s2cid", "bibcode", "pmid", "原始內容", "存檔於", "[永久失效連結]")
EVALUATED_MARKS = ("doi:", "arxiv:", "isbn", "issn", "s2cid", "bibcode", "pmid", "原始內容", "存檔於", "永久失效連結", "檢自")
# Text that only a page's frame has.
BOILERPLATE = (
    "toggle the table of contents", "what links here", "learn how and when to remove", "this article needs more citations",
    "please help improve", "find sources:", "jump to content", "create account log in", "personal tools", "move to sidebar",
    "edit view history", "permanent link page information", "cite this page", "printable version", "add languages",
    "本頁面最後修訂於", "維基百科，自由的百科全書", "檢視方式", "不转换 简体 繁體",
)
# Words that name no topic.
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "has", "had", "was", "were", "are", "not", "but", "you", "your",
    "they", "them", "their", "its", "his", "her", "our", "out", "who", "which", "what", "when", "where", "how", "why", "all", "any",
    "can", "will", "would", "could", "should", "may", "might", "must", "into", "over", "than", "then", "there", "these", "those",
    "such", "some", "more", "most", "other", "also", "been", "being", "about", "after", "before", "between", "because", "while",
    "does", "did", "each", "only", "same", "very", "just", "much", "many", "one", "two", "three", "use", "used", "using", "make",
    "made", "way", "well", "get", "see", "new", "now", "per", "via", "etc",
)
# What of a page is no content (tag names, #ids, .classes, roles), and where content stands, in order.
PRUNED = (
    "script", "style", "noscript", "template", "svg", "form", "nav", "header", "footer", "aside",
    "[role=navigation]", "[role=banner]", "[role=contentinfo]", "[role=search]",
    ".navbox", ".vertical-navbox", ".sidebar", ".sistersitebox", ".mw-editsection", ".mw-jump-link", ".mw-indicators", ".mw-footer",
    "#toc", ".toc", "#siteSub", "#contentSub", ".reflist", ".references", "ol.references", ".reference", ".refbegin",
    ".mw-references-wrap", ".citation", ".hatnote", ".ambox", ".mbox-text", ".metadata", ".ambox-content", ".catlinks",
    ".printfooter", ".noprint", ".shortdescription", ".cookie-banner", ".cookie-consent", ".newsletter", ".breadcrumb",
    ".share", ".social", ".related-posts", ".comments", "#comments",
)
CONTAINERS = (
    "main", "article", "[role=main]", "#mw-content-text", ".mw-parser-output", ".main-content", "#main-content", ".entry-content",
    ".post-content", ".article-body", ".content", "#content", ".post",
)
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dd", "dt", "blockquote", "pre", "figcaption", "caption", "tr")
COVERAGE = 0.4
# How a provider names a token limit, and how a limit on requests.
TOKEN_LIMIT = r"(?i)\bLimit[\s:]+(\d{3,})"
TOKEN_MARKS, REQUEST_MARKS = ("token", "too large", "rate_limit", "rate limit"), ("requests per", "request per", "(rpm)", "(rpd)")
# Digests and scripts.
EXCERPT, TOPICS, BULLETS, BULLET_CHARS, LEAST_WORDS, WORDS_PER_SECOND = 1200, 6, 4, 120, 3, 2.6
# Characters that NFKC leaves alone and that combine with none: ASCII, Latin, Greek and Cyrillic letters, dashes and quotes, kana, ideographs, Hangul.
NFKC_STABLE = (
    "\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u0391-\\u03a1\\u03a3-\\u03c1\\u03c3-\\u03c9"
    "\\u0400-\\u0481\\u048a-\\u04ff\\u2013-\\u2015\\u2018-\\u2022\\u20ac\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30a1-\\u30fa\\u30fc\\u4e00-\\u9fff\\uac00-\\ud7a3"
)
# Markdown that isn't spoken: fenced and inline code, links and images, marks at the start of a line (heading, quote, list), emphasis, rules, pipes and addresses.
FENCE, CODE, LABELLED = r"(?s)```.*?```", "`([^`]*)`", r"!?\[([^\[\]]*)\]\([^)]*\)"
LINE_MARKS = r"^(?:\s{0,3}#{1,6}\s*)?(?:\s{0,3}>\s?)?(?:\s*[-*+]\s+)?"
EMPHASIS = r"\*\*(.*?)\*\*|__(.*?)__|\*(.*?)\*|_(.*?)_"
RULE, UNSPOKEN = r"^\s*(?:[-*_]\s*){3,}$", r"\||https?://\S+"
# What an answer without a model says around it, and where there is nothing to extract.
ANSWER_HEAD = "Based on the provided documents:\n\n"
ANSWER_NOTE = "\n\n(Note: This is a simplified response. Configure an LLM for better answers.)"
NO_ANSWER = (
    "I understand you're asking about this topic. However, I need an LLM service configured to provide detailed answers. "
    "Please configure an API key for Claude or OpenAI, or run a local model server."
)
# Languages of captions, in the order in which they are preferred.
CAPTION_LANGUAGES = ("en", "zh-TW", "zh-CN", "zh")
# What a model is told before a context (own wording), with and without the wish for citations.
ANSWER_RULES = "Answer from the context below. Say so if it does not hold the answer."
CITING_RULES = " Name the sources you use as [Source n]."

"""Word lists, patterns and thresholds that results depend on."""

# Fixed values of the retrieval and precedence rules, in natural order.
STOPWORDS = """
a an the and or of to in for on at by with without from as is are was were be been
being that this these those it its their they them he she we you your our not no any
all each such same only own so very do does did doing have has had having but because
until while about against between into through during before after above below up down
out off over under again further once here there both few nor too per within upon shall
will may must can if then than which who whom what when where how also more most other
others said case cases participant participants team teams rule rules rulebook article
articles ewc global tournament
""".split()

TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
CONTENT = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
WORD = r"[a-z0-9]+"
PARENTHETICAL = r"\(([^()]{0,500})\)"
CITATION = r"^.+? — (?:Article \S+?, )?p\.\d+$"
LOCATOR = r"^(.+?) — Article (\S+?), p\.\d+$"
HEADING = r"^#{1,6}\s+"

# Fixed values of document structure: article numbers, heading lines, appendix marks, contents listings.
ARTICLE = r"[A-Z]?\d{1,2}(?:\.\d{1,2}){0,4}"
ARTICLE_LINE = rf"^({ARTICLE})(?:\.[ ]*|[ ]+)(?![\d.])(\S.*)$"
ARTICLE_ALONE = r"^([A-Z]?\d{1,2}(?:\.\d{1,2}){0,4})\.$|^([A-Z]?\d{1,2}(?:\.\d{1,2}){1,4})$"
RUN_IN = r"^([A-Z][^.;:]{1,88})\.\s+(\S.*)$"
ASIDE = r"^\([^)]*\)[\s.;:,]*$"
BARE_NUMBER = r"^\d{1,4}$"
DOT_LEADER = r"\.{4,}"
CONTENTS = r"^(?:table of contents?|contents)$"
PART = r"^(Appendix|Annex|Schedule|Exhibit)\s+([IVXLC]+|[A-Z]|\d{1,2})\b[\s:.–—-]+([A-Z“\"'(].{0,60})$"
PART_ALONE = r"^(Appendix|Annex|Schedule|Exhibit)\s+([IVXLC]+|[A-Z]|\d{1,2})\.?$"

DENSE_K, LEXICAL_K, FUSED_K, RRF_K, ACCOUNTABLE_RANK, MISSING_RANK = 12, 12, 8, 60, 4, 99
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SAME_HEADING, SAME_LEAD, SAME_BODY, AGREEMENT, INCORPORATED, MIN_LEAD_WORDS = 0.60, 0.70, 0.35, 0.50, 0.70, 6
SUBJECT_WINDOW, OBJECT_WINDOW, GAP_COVERAGE, GAP_MIN_TERMS, GAP_SUBJECT_WORDS = 60, 20, 0.80, 3, 16
VERBATIM_LIMIT, VERBATIM_GATE, SIBLINGS_IN_USE = 20, 25, 2
MAX_CHARS, OVERLAP, MIN_BODY, MAX_HEADING, MAX_LINE, TOC_RUN_MIN = 1200, 150, 20, 90, 100, 5
MAX_EMBEDDING_TOKENS, BAND, LEAST_PAGES = 8191, 3, 4
BUDGET_DAY, BUDGET_CONVERSATION, BUDGET_ESTIMATE = 0.50, 0.25, 0.0015
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

SILENCE = (
    r"\b(?:does|do|did)\s+not\s+(?:state|contain|address|cover|specify|provide"
    r"|mention|include|say|set\s+out|establish|impose|define)\b"
    r"|\b(?:is|are|was|were)\s+silent\b"
    r"|\b(?:has|have|contains?|includes?)\s+no\s+(?:rule|provision|article|text|specific)"
    r"|\bno\s+(?:rule|provision|article|text)s?\s+(?:on|for|about|regarding|covering)\b"
    r"|\bnothing\s+(?:on|about|regarding)\b"
    r"|\bnot\s+(?:stated|addressed|covered|mentioned|specified)\b"
)
SILENCE_BEFORE_BOOK = (
    r"\bno\s+(?:\w+\s+){0,3}(?:rule|provision|article|text|mention|reference|guidance)s?"
    r"\s+(?:in|from|within)\s+(?:the\s+)?"
)
SUBJECT_SHIFT = (
    r"\b(?:excerpts?|passages?|retrieved\s+text|text\s+provided|provided\s+text"
    r"|articles?|provisions?|sections?)\b"
)
EXCERPT_FRAMED = (
    r"\b(?:the\s+)?(?:retrieved\s+)?(?:excerpts?|passages?|retrieved\s+(?:rulebook\s+)?text"
    r"|provided\s+text|text\s+provided)\b[^.]{0,40}?"
    r"\b(?:do|does|did)\s+not\s+"
    r"(?:state|contain|address|cover|specify|provide|mention|include|say|indicate|answer)\b"
)
EXPRESS_PRIMACY = (
    r"even if the (?:respective )?game[- ]title rulebook[^.]*\."
    r"|regardless of (?:what |any |the )?(?:respective )?game[- ](?:title|specific) rul\w+[^.]*\."
    r"|notwithstanding[^.]{0,80}game[- ](?:title|specific) rul\w+[^.]*\."
    r"|(?:shall |will )?(?:prevail|take[s]? precedence|govern[s]?) over "
    r"(?:the |any )?(?:respective )?game[- ](?:title|specific) rul\w+[^.]*\."
)
RESTATES = r"global\s+rul"

# Fixed values of cross references, hedges, page labels and book names.
XREF_ARTICLE = r"(?:section|article|art\.)\s+(\d{1,2}(?:\.\d{1,3})+)"
XREF_BOOK = r"global\s+rulebook"
HEDGES = "typically usually generally commonly".split()
FOOTER = r"^[\s\-–—_.·|]*(?:page\s*)?(\d{1,4})(?:\s*(?:of|/)\s*\d{1,4})?[\s\-–—_.·|]*$"
ALIAS_MIN = 3
ALIAS_STOPWORDS = """
free fire fatal fury kings honor arena valor women mobile legends world cup
sports the and pro open esports rulebook global bang tactics league siege
street fighter ops competitive
""".split()
MAX_PART, MAX_PART_TITLE, MOST_HEADING_WORDS = 80, 60, 12
EST_OUTPUT_TOKENS, RETRY_FACTOR, ROUTER_TOKENS_IN, ROUTER_TOKENS_OUT = 500, 1.8, 700, 15
CHAT_RATES = {"gpt-4o-mini": (0.15, 0.60)}

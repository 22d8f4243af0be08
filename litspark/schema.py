"""Fixed values of the data model: columns, periods, journals, markers and templates."""

from __future__ import annotations

PAPER_COLUMNS = ["title", "authors", "abstract", "url", "journal", "year"]

# Cell texts that CSV readers of the source data treat as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A title holding one of these is a book review.
REVIEW_MARKS = ["pp.", " p."]

# Links that lead nowhere.
BROKEN_LINKS = ["http://hdl.handle.net/", "https://hdl.handle.net/"]

# Period name, first year, first year after it (None = open).
PERIODS = [
    ("b2000", None, 2000),
    ("2000s", 2000, 2010),
    ("2010s", 2010, 2015),
    ("2015s", 2015, 2020),
    ("2020s", 2020, 2025),
    ("2025s", 2025, None),
]
PERIOD_NAMES = [p[0] for p in PERIODS]

# The oldest period is stored as two halves, the others whole.
SPLIT_PERIOD = "b2000"
FILE_ENTRIES = ["b2000_part1", "b2000_part2", "2000s", "2010s", "2015s", "2020s", "2025s"]

# Default model and vector width of a manifest, batch size, size limit of a file.
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
DEFAULT_DIM = 384
ENCODE_BATCH = 32
MAX_FILE_MB = 50

# Characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A word: two or more letters, digits or underscores.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = WORD_CHARACTER + "{2,}"

# Labels of the training pairs and their shares of the wanted total.
PAIR_LABELS = {"title_abstract": 1.0, "journal_year": 0.7, "query": 0.9, "negative": 0.1}
PAIR_TOTAL = 80000

# Query templates and the words that fill a template when terms are short.
QUERY_TEMPLATES = [
    "{} analysis",
    "{} and {} study",
    "impact of {}",
    "{} empirical evidence",
    "effects of {} on {}",
    "{} in economics",
]
TEMPLATE_FILLERS = ["economic", "policy", "market"]

# The English stop words Spark ships, without the ones holding an apostrophe
# (the word pattern never yields those).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now "
    "cannot could ought would"
).split()

# Journal codes offered by default and in the full set, in menu order.
CORE_JOURNALS = (
    "aer jpe qje ecta restud aejmac aejmic aejapp aejpol aeri jpemic jpemac restat jeea eer ej jep jel are qe jeg "
    "jet te joe jme red rand jole jhr jie ier jpube jde jeh jue jhe"
).split()
EXTRA_JOURNALS = (
    "jae geb jinde jlawe jebo ee ectt ehr eeh imfer ecot jmcb edcc sje ecoa jaere jeem wber ijio jleo le jpope qme "
    "ei jedc cej obes jems jes jmate rsue eedur jhc efp aler jbes jf jfe rfs ms jbf smj rp bpea er ijgt ntj md "
    "jdeme oxe jei riw ajhe nberma aerpp"
).split()

# Named journal groups.
JOURNAL_GROUPS = {
    "top5": ["aer", "jpe", "qje", "ecta", "restud"],
    "general": ["aer", "jpe", "qje", "ecta", "restud", "aeri", "restat", "jeea", "eer", "ej", "qe"],
    "survey": ["jep", "jel", "are"],
}

# Journal code and name.
JOURNAL_LEGEND = """
aejapp: AEJ Applied Economics
aejmac: AEJ Macroeconomics
aejmic: AEJ Micro
aejpol: AEJ Policy
aer: American Economic Review
aeri: AER Insights
are: Annual Review of Economics
ecta: Econometrica
ej: Economic Journal
eer: European Economic Review
ier: International Economic Review
jde: Journal of Development Economics
jeea: Journal of the European Economic Association
jeg: Journal of Economic Growth
jeh: The Journal of Economic History
jel: Journal of Economic Literature
jep: Journal of Economic Perspectives
jet: Journal of Economic Theory
jhe: Journal of Health Economics
jhr: Journal of Human Resources
jie: Journal of International Economics
joe: Journal of Econometrics
jole: Journal of Labor Economics
jme: Journal of Monetary Economics
jpe: Journal of Political Economy
jpemic: Journal of Political Economy Microeconomics
jpemac: Journal of Political Economy Macroeconomics
jpube: Journal of Public Economics
jue: Journal of Urban Economics
qe: Quantitative Economics
qje: Quarterly Journal of Economics
rand: RAND Journal of Economics
red: Review of Economic Dynamics
restud: Review of Economic Studies
restat: Review of Economics and Statistics
te: Theoretical Economics
aerpp: AER Papers and Proceedings
ajhe: American Journal of Health Economics
aler: American Law and Economics Review
bpea: Brookings Papers on Economic Activity
cej: Canadian Journal of Economics
ecoa: Economica
ecot: Econometric Theory
er: Econometric Reviews
edcc: Economic Development and Cultural Change
ee: Experimental Economics
eedur: Economics of Education Review
eeh: Explorations in Economic History
efp: Education Finance and Policy
ehr: Economic History Review
ei: Economic Inquiry
geb: Games and Economic Behavior
ijio: International Journal of Industrial Organization
ijgt: International Journal of Game Theory
imfer: IMF Economic Review
jae: Journal of Applied Econometrics
jaere: Journal of the Association of Environmental and Resource Economists
jbf: Journal of Banking & Finance
jbes: Journal of Business & Economic Statistics
jdeme: Journal of Demographic Economics
jedc: Journal of Economic Dynamics and Control
jei: Journal of Economic Inequality
jemstr: Journal of Economics & Management Strategy
jeem: Journal of Environmental Economics and Management
jecsur: Journal of Economic Surveys
jebo: Journal of Economic Behavior & Organization
jf: Journal of Finance
jfe: Journal of Financial Economics
jhc: Journal of Housing Economics
jinde: Journal of Industrial Economics
jpope: Journal of Population Economics
jleo: Journal of Law, Economics, and Organization
jlawe: Journal of Law and Economics
jmcb: Journal of Money, Credit and Banking
jmate: Journal of Mathematical Economics
le: Labour Economics
md: Macroeconomic Dynamics
ms: Management Science
nberma: NBER Macroeconomics Annual
obes: Oxford Bulletin of Economics and Statistics
oxe: Oxford Economic Papers
qme: Quantitative Marketing and Economics
rsue: Regional Science and Urban Economics
rp: Research Policy
rfs: Review of Financial Studies
riw: Review of Income and Wealth
sje: Scandinavian Journal of Economics
smj: Strategic Management Journal
wber: World Bank Economic Review
"""


def journal_names() -> dict[str, str]:
    """Journal code to name, for the codes that have one."""
    return dict(line.split(": ", 1) for line in JOURNAL_LEGEND.strip().splitlines())

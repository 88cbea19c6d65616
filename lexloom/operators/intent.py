"""Classification and routing of questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import accept_rewrite, query_language, rewrite_needed

# Patterns of question types and of domains, in the order in which they are tried.
QUESTION_TYPES = (
    ("law_search", r"(?:show|find|search|what is|where is|কী\s*(?:হলো|বলে)|দেখাও|খুঁজ)\s*(?:me\s+)?(?:article|ধারা|section|অনুচ্ছেদ)\s*[0-9০-৯]+"),
    ("law_search", r"^(?:article|section|ধারা|অনুচ্ছেদ)\s*[0-9০-৯]+[a-z]*"),
    ("act_summary", r"summar[iy]ze|সারসংক্ষেপ|explain\s+(?:the\s+)?(?:act|আইন)"),
    ("act_summary", r"what\s+(?:does|is)\s+the\s+.+\s+(?:act|আইন)\s+(?:say|about)"),
    ("act_summary", r"give\s+me\s+(?:a\s+)?summary|overview\s+of"),
    ("amendment_question", r"amendment|সংশোধন"),
    ("amendment_question", r"what\s+changed|কী\s+পরিবর্তন|what\s+is\s+new"),
    ("amendment_question", r"before\s+and\s+after|compare|তুলনা"),
    ("fact_analysis", r"my\s+(?:landlord|employer|boss|tenant|neighbor|husband|wife)"),
    ("fact_analysis", r"আমার\s+(?:বাড়িওয়ালা|মনিব|প্রতিবেশী|স্বামী|স্ত্রী)"),
    ("fact_analysis", r"happened\s+to\s+me|what\s+can\s+i\s+do|what\s+are\s+my\s+rights"),
    ("fact_analysis", r"আমি\s+কী\s+করতে\s+পারি|আমার\s+কী\s+অধিকার"),
    ("fact_analysis", r"someone\s+(?:stole|took|damaged|did)|কে\s+(?:নিয়ে|করেছে)"),
)
DOMAINS = (
    ("criminal", r"punishment|শাস্তি|crime|অপরাধ|theft|চুরি|murder|হত্যা|offence"),
    ("election", r"election|নির্বাচন|vote|ভোট|candidate|প্রার্থী|nomination|মনোনয়ন"),
    ("employment", r"employment|চাকরি|service|employee|কর্মচারী|government\s+servant"),
    ("constitution", r"constitution|সংবিধান|fundamental\s+right|মৌলিক\s+অধিকার"),
    ("administrative", r"administrative|প্রশাসনিক|government|সরকারি|authority|কর্তৃপক্ষ"),
    ("tax", r"tax|কর|income|আয়|revenue|রাজস্ব|vat|ভ্যাট"),
    ("civil", r"property|সম্পত্তি|contract|চুক্তি|land|জমি|family|পারিবারিক"),
)
ROUTES = {"law_search": "law_search_agent", "fact_analysis": "legal_analysis_agent", "act_summary": "act_summary_agent", "amendment_question": "amendment_compare_agent"}
DEFAULT_ROUTE = "legal_qa_agent"
#: Results fetched and results put into the context, by route.
RESULTS = {"law_search_agent": (10, 8), "legal_analysis_agent": (12, 8), "act_summary_agent": (20, 15), "amendment_compare_agent": (15, 8), "legal_qa_agent": (8, 8)}


def first_match(text: Column, patterns, default: Column) -> Column:
    """Label of the first pattern found in lower-cased text. A null text takes the default."""
    low, out = F.lower(text), None
    for label, pattern in patterns:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise(default)


def question_type(text: Column, retrieved: Column | None = None) -> Column:
    other = F.lit("legal_question") if retrieved is None else F.when(retrieved == 0, "no_results").otherwise("legal_question")
    return first_match(text, QUESTION_TYPES, other)


def domain(text: Column) -> Column:
    return first_match(text, DOMAINS, F.lit("general"))


def route(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in ROUTES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(DEFAULT_ROUTE))


def classify(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add language, query_type, legal_domain, needs_rewrite, routed_agent, top_k and max_chunks; a preset type is kept."""
    q = F.col(question)
    have = set(questions.columns)
    preset = lambda c, made: F.coalesce(F.nullif(F.col(c), F.lit("")), made) if c in have else made
    out = questions.withColumns({"language": preset("language", query_language(q)), "query_type": preset("query_type", question_type(q)), "legal_domain": domain(q), "needs_rewrite": rewrite_needed(q)})
    out = out.withColumn("routed_agent", route(F.col("query_type")))
    limits = F.create_map(*[F.lit(x) for r, (k, m) in RESULTS.items() for x in (r, k)])
    shown = F.create_map(*[F.lit(x) for r, (k, m) in RESULTS.items() for x in (r, m)])
    return out.withColumn("top_k", limits[F.col("routed_agent")]).withColumn("max_chunks", shown[F.col("routed_agent")])


def apply_rewrite(questions: DataFrame, rewritten: str, question: str = "question") -> DataFrame:
    """Add rewritten_question: the rewrite where one is needed and long enough, else the question."""
    out = F.when(F.col("needs_rewrite"), accept_rewrite(question, F.coalesce(F.col(rewritten), F.lit("")))).otherwise(F.col(question))
    return questions.withColumn("rewritten_question", out)

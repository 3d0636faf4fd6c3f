"""What stays unknown of a site's company, what to ask its owner, and who leads it, from one row of facts.

Besides the facts of `scoring`, rows may hold roles_read, dependency_names and compliance_names (arrays of strings) and
customer_claim (boolean); a column that is not there counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring

# What no site tells.
STRUCTURAL_UNKNOWNS = [
    "Revenue, margins, and profitability",
    "Customer concentration and churn",
    "Cost base, including staff and platform costs",
    "Owner involvement and how transferable the operation is",
    "Existing contracts, liabilities, and any litigation",
    "Ownership of IP, domains, and third-party accounts",
]
# Questions by revenue model, and those asked of everybody.
MODEL_QUESTIONS = {
    "saas": [
        "What are current MRR/ARR, and the growth rate over the last 24 months?",
        "What is gross and net revenue retention, and monthly logo churn?",
        "What share of revenue comes from the top 10 accounts?",
        "What is customer acquisition cost and payback period, by channel?",
        "How much of the base is on annual vs monthly contracts, and are they assignable?",
        "What does infrastructure cost per customer, and how does it scale?",
    ],
    "ecommerce": [
        "What are revenue, gross margin, and contribution margin by SKU?",
        "What are average order value and repeat purchase rate?",
        "Who are the suppliers, and are the agreements exclusive and transferable?",
        "What inventory is on hand, and how is it valued?",
        "What share of traffic and revenue is paid, and what is blended ROAS?",
        "What is the returns and chargeback rate?",
    ],
    "local_services": [
        "What were revenue and gross margin per job over the last three years, by service line?",
        "What share of work is recurring contracts versus one-off callouts?",
        "How seasonal is the work, and what does the slowest quarter look like?",
        "How many crews and licensed technicians are there, and what is staff turnover?",
        "Which licences and insurance policies are held, in whose name, and do they transfer?",
        "Are vehicles, plant, and equipment owned, financed, or leased — and what is their condition?",
        "How much selling and estimating does the owner personally do?",
        "Where does new work come from — referrals, Google, trucks, or paid ads?",
    ],
    "services": [
        "What is revenue by client, and what share is the largest client?",
        "What is the split between recurring retainers and one-off projects?",
        "What are utilisation rates and average billing rates?",
        "How much delivery work does the owner personally perform?",
        "What does the signed pipeline look like for the next two quarters?",
        "Which staff are critical, and what are their notice periods?",
    ],
    "marketplace": [
        "What are GMV, take rate, and net revenue over the last 24 months?",
        "How concentrated are both supply and demand sides?",
        "What is liquidity — match rate and time to fill?",
        "What are repeat rates for buyers and for sellers?",
        "How much of supply is exclusive to this platform?",
    ],
    "media": [
        "What are traffic volumes and sources, and how exposed are they to search algorithm changes?",
        "What is the split between advertising, sponsorship, subscription, and affiliate revenue?",
        "How concentrated are sponsors or advertisers?",
        "What is the email list size, and its open and click rates?",
        "Who creates the content, and do they stay after a sale?",
    ],
    "hardware": [
        "What are unit economics — COGS, landed cost, and gross margin?",
        "How concentrated is the supplier base, and are contracts transferable?",
        "What inventory and tooling is owned, and where does it sit?",
        "What are warranty, defect, and return rates?",
        "What certifications does the product hold, and do they transfer?",
    ],
}
UNIVERSAL_QUESTIONS = [
    "Can you provide three years of P&L, balance sheet, and tax returns?",
    "Why are you selling, and what happens to you post-close?",
    "What would break if the current owner stopped working tomorrow?",
    "Are all domains, platform accounts, and IP owned by the selling entity?",
]
MOST_QUESTIONS = 14
# Titles by seniority, the highest first; other titles come after them all.
SENIORITY = [
    (r"\b(founder|co-?founder|owner|ceo|chief executive)\b", 0),
    (r"\b(president|managing (director|partner))\b", 1),
    (r"\b(c[toifpm]o|chief \w+)\b", 2),
    (r"\b(vp|vice president)\b", 3),
    (r"\bhead of\b", 4),
    (r"\bdirector\b", 5),
]
OTHER_TITLE = 9
# Fixed value: titles of those who lead.
EXECUTIVE = r"\b(ceo|cto|coo|cfo|cmo|cpo|cio|chief \w+|founder|co-?founder|owner|president|managing director|managing partner|vp\b|vice president|head of)\b"


def _facts(facts: DataFrame) -> DataFrame:
    """Complete facts with this module's own columns, empty where they are not given."""
    own = {"roles_read": "array<string>", "dependency_names": "array<string>", "compliance_names": "array<string>", "customer_claim": "boolean"}
    more = [F.coalesce(F.col(c) if c in facts.columns else F.lit(None).cast(t), F.lit(False) if t == "boolean" else F.array().cast(t)).alias(c) for c, t in own.items()]
    return scoring.complete(facts).join(facts.select("site", *more), "site")


def _texts(texts: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in texts]) if texts else F.array().cast("array<string>")


def _model() -> Column:
    return F.coalesce(F.col("model"), F.lit("unknown"))


def unknowns(facts: DataFrame) -> DataFrame:
    """(site, place, unknown): what no site tells, then what this one leaves open. A page that was read but told nothing is
    worded otherwise than one that was not found."""
    c, read = F.col, lambda role: F.array_contains("roles_read", role)
    rules = [
        (c("prices") == 0, F.lit("Pricing — nothing public was found")),
        (c("people") == 0, F.lit("Who owns and runs the business")),
        (c("open_roles").isNull(), F.when(read("careers"), "Hiring activity — the careers page listed nothing countable").otherwise("Hiring activity — no careers page was found")),
        (c("last_content_age").isNull(), F.when(read("blog"), "Publishing cadence — the blog carried no readable dates").otherwise("Publishing cadence — no dated content was found")),
        ((c("customers") == 0) & ~c("customer_claim"), F.lit("Customer base — no customers or counts are named publicly")),
        (_model() == "unknown", F.lit("How the business actually charges — the site does not make it clear")),
    ]
    told = F.concat(_texts(STRUCTURAL_UNKNOWNS), F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules])))
    return _facts(facts).select("site", F.posexplode(told).alias("place", "unknown"))


def questions(facts: DataFrame) -> DataFrame:
    """(site, place, question): those of the revenue model, those that the facts raise, those for everybody; a question that
    differs from an earlier one in case alone is left out, and MOST_QUESTIONS are kept."""
    c = F.col
    by_model = F.create_map(*[x for m, qs in MODEL_QUESTIONS.items() for x in (F.lit(m), _texts(qs))])
    rules = [
        (F.size("dependency_names") > 0, F.concat(F.lit("The site runs on "), F.array_join("dependency_names", ", "), F.lit(" — who holds the account, and does it transfer at close?"))),
        (c("last_content_age").isNull() | F.coalesce(c("copyright_age") >= 3, F.lit(False)), F.lit("The site shows little recent activity — is the business still trading at normal volume?")),
        (c("people") <= 1, F.lit("Who else works in the business, as employees or contractors, and on what terms?")),
        (F.size("compliance_names") > 0, F.concat(F.lit("Can you share the current audit reports behind the "), F.array_join("compliance_names", ", "), F.lit(" claims?"))),
    ]
    raised = F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))
    every = F.concat(F.coalesce(F.try_element_at(by_model, _model()), _texts([])), raised, _texts(UNIVERSAL_QUESTIONS))
    lows = F.transform(every, lambda q: F.lower(q))
    first = F.filter(every, lambda q, i: F.array_position(lows, F.lower(q)) == i + 1)
    return _facts(facts).select("site", F.posexplode(F.slice(first, 1, MOST_QUESTIONS)).alias("place", "question"))


def seniority(title: Column) -> Column:
    out = F.when(title.rlike("(?i)" + SENIORITY[0][0]), SENIORITY[0][1])
    for pattern, rank in SENIORITY[1:]:
        out = out.when(title.rlike("(?i)" + pattern), rank)
    return out.otherwise(OTHER_TITLE)


def leadership(people: DataFrame) -> DataFrame:
    """people (site, ord, name, title) to (site, leaders): array<struct<rank, ord, name, title>> of those with an executive
    title, the most senior first, equals in the order in which they were found."""
    ranked = people.where(F.coalesce("title", F.lit("")).rlike("(?i)" + EXECUTIVE)).withColumn("rank", seniority(F.col("title")))
    return ranked.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("rank", "ord", "name", "title"))).alias("leaders"))


def by_category(found: DataFrame) -> DataFrame:
    """found (site, category, name) to (site, category, names): each name once, in order of the alphabet."""
    return found.groupBy("site", "category").agg(F.array_sort(F.collect_set("name")).alias("names"))

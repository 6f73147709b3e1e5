"""Fixed values that results depend on: word lists, patterns, weights and limits."""

from __future__ import annotations

#: Stop words of the similarity tokenizer.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into about like through after over between out against during without before under around among "
    "and but or nor not so yet both either neither each every all any few more most other some such no only own same than too very just because if when where how what which who whom this that these those it its i me my we our you your he him his she her they them their"
).split()
PUNCTUATION = ".,;:!?()[]{}\"'"

#: Stop words and punctuation of the expansion tokenizer.
SHORT_STOP_WORDS = "the and for that this with are was were has have had not but from they its been into than then them can will may our also".split()
SHORT_PUNCTUATION = ".,!?;:\"'()[]{}-_/"

NEGATION_WORDS = "not no never isn't aren't wasn't doesn't don't cannot can't".split()

TEMPORAL_CUES = ("change", "changed", "original", "before", "after", "previous", "current", "first", "initially", "updated", "revised", "intermediate", "over time", "history", "evolution", "timeline", "when")

PROCEDURAL_WORDS = ("step", "steps", "how to", "procedure", "process", "method", "recipe", "instructions")
PROSPECTIVE_WORDS = ("plan", "goal", "future", "will", "should", "todo", "intend", "schedule")
EPISODIC_WORDS = ("happened", "event", "occurred", "experience", "observed", "saw", "noticed")

#: Credential patterns, in the order in which they are applied.
CREDENTIALS = (
    r"AKIA[0-9A-Z]{16}",
    r"""aws_secret_access_key["'\s:=]+([A-Za-z0-9/+=]{40})""",
    r"sk-[A-Za-z0-9]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"AccountKey=[A-Za-z0-9+/]{86}==",
    r"""(?i)password["'\s:=]+([^\s"']+)""",
    r"""(?i)token["'\s:=]+([A-Za-z0-9\-._~+/]+=*)""",
    r"""(?i)api[_\-]?key["'\s:=]+([A-Za-z0-9\-._~+/]+=*)""",
    r"""(?i)secret["'\s:=]+([A-Za-z0-9\-._~+/]+=*)""",
    r"-----BEGIN (?:RSA|DSA|EC|OPENSSH) PRIVATE KEY-----",
    r"(?:postgres|mysql|mongodb)://[^:]+:([^@]+)@",
)
REDACTED = "[REDACTED]"
SCRUBBED_TAG = "credential_scrubbed"

#: Query cost: base, whole-table scan, join, subquery, sort, missing limit.
COST_BASE, COST_SCAN, COST_JOIN, COST_SUBQUERY, COST_SORT, COST_NO_LIMIT = 1, 10, 5, 3, 2, 20
DENIED_SQL = "DELETE UPDATE INSERT DROP TRUNCATE ALTER CREATE REPLACE GRANT REVOKE UNION ATTACH PRAGMA VACUUM REINDEX SAVEPOINT BEGIN COMMIT ROLLBACK".split()
DENIED_SQL_LENIENT = "DELETE UPDATE INSERT DROP TRUNCATE ALTER CREATE REPLACE GRANT REVOKE".split()
DENIED_CYPHER = "DELETE DETACH SET REMOVE MERGE CREATE CALL LOAD FOREACH".split()

#: Scopes, lowest first; a scope includes those before it.
SCOPES = ("session_only", "cross_session_read", "cross_session_write", "global_read", "global_write")
EXPERIENCE_TYPES = ("success", "failure", "pattern", "insight")
MEMORY_TYPES = ("sensory", "working", "episodic", "semantic", "procedural", "prospective")

#: Proper names: hyphenated or apostrophised words, or two and more capitalised words.
NAME_PATTERN = r"\b([A-Z][a-z]*(?:['’\-][A-Z]?[a-z]+)+(?:\s+(?:[A-Z][a-z]+(?:['’\-][A-Z]?[a-z]+)?))*|[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+(?:['’\-][A-Z]?[a-z]+)?))+)\b"
NUMBER_PATTERN = r"\b\d+(?:\.\d+)?\b"

CLAUSE_SEPARATORS = ("; ", ", and ", ", but ", ", so ")
MIN_CLAUSE_WORDS = MIN_FACT_WORDS = 3

#: Ranked recall: weights of the signals, half-life of recency, largest number of hops.
RECALL_WEIGHTS = {"text": 1.0, "confidence": 0.7, "importance": 0.5, "recency": 0.4, "usage": 0.3, "graph": 0.6}
HALF_LIFE_SECONDS = 604_800.0
MAX_GRAPH_HOPS = 3

#: Composite similarity: words, tags, concept; score from which similar facts are linked.
SIMILARITY_WEIGHTS = (0.5, 0.2, 0.3)
LINK_THRESHOLD = 0.6

WORKING_CAPACITY = 20
SENSORY_TTL_SECONDS = 300
SUPERSEDE_CANDIDATES = 20
PATTERN_THRESHOLD = 3
PATTERN_EXAMPLES = 5

#: Legal moves between the states of a creative idea.
TRANSITIONS = {
    "New": ("AcceptedForImplementation", "Rejected", "Deferred", "NeedsRevision", "NeedsHumanReview"),
    "NeedsRevision": ("New", "Rejected", "Deferred"),
    "NeedsHumanReview": ("AcceptedForImplementation", "Rejected", "Deferred"),
    "AcceptedForImplementation": ("ImplementationStarted", "Deferred", "Rejected"),
    "Rejected": (),
    "Deferred": ("New", "Rejected"),
    "ImplementationStarted": ("ImplementationCompleted", "NeedsRevision", "Rejected"),
    "ImplementationCompleted": (),
}

#: Intent kinds of the change log.
INTENT_KINDS = ("store_fact", "store_procedure", "store_episode", "store_prospective", "link_fact_to_episodes", "link_similar_facts", "upsert_fact", "record_access")
MAX_READ_LIMIT = 10_000

"""The line rules as data. Titles, severities, patterns, messages and fixes are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """One detection on a line.

    ``needles`` are literal texts every match must contain (a tuple means any one of them): a cheap test
    before the regex, never a change of its result. ``needs_async`` and ``min_loop_depth`` are guards on the
    scope around the line.
    """

    rule_id: str
    category: str
    severity: str
    title: str
    pattern: str
    message: str
    suggested_fix: str | None
    confidence: float
    needles: tuple = ()
    needs_async: bool = False
    min_loop_depth: int = 0

    @property
    def regex(self) -> str:
        """Unicode-aware classes and word boundaries, as the rules are meant."""
        return "(?U)" + self.pattern


# Fixed values.
SECURITY_RULES = [
    Rule("SEC-001", "security", "critical", "Hardcoded Secret / API Token Detected",
         r"""(?i)(?:api_key|apikey|secret_key|private_key|auth_token|access_token|password|passwd|client_secret)\s*=\s*['"][a-zA-Z0-9_\-\.]{8,}['"]""",
         "Potential hardcoded secret or credential found in source code. Credentials must be loaded via environment variables or a secure secret manager.",
         "Use `os.getenv('SECRET_NAME')` or Pydantic `BaseSettings` instead of hardcoding credentials.",
         0.95, ("=", ("'", '"'))),
    Rule("SEC-002", "security", "critical", "AWS Access Key Exposed",
         r"""(AKIA[0-9A-Z]{16})""",
         "Exposed AWS Access Key ID detected. This poses an immediate compromise risk.",
         "Revoke this key immediately in AWS IAM and load credentials via AWS IAM Roles or environment variables.",
         0.95, ("AKIA",)),
    Rule("SEC-003", "security", "high", "SQL Injection Risk via Dynamic String Interpolation",
         r"""(?i)(?:f["'].*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b|(?:execute|raw|query)\s*\(\s*(?:f["']|["'].*(?:SELECT|INSERT|UPDATE|DELETE)))""",
         "Raw SQL query constructed using string formatting/interpolation. User input can bypass database authorization and corrupt or exfiltrate data.",
         "Use parameterized queries or ORM query bindings (e.g. `cursor.execute('SELECT * FROM users WHERE id = %s', (user_id,))`).",
         0.95, (("'", '"'),)),
    Rule("SEC-004", "security", "high", "Dangerous `eval` / `exec` Execution",
         r"""\b(eval|exec)\s*\(""",
         "Dynamic code execution via `eval` or `exec` allows arbitrary remote code execution (RCE) if input is untrusted.",
         "Replace `eval`/`exec` with safe parsers such as `ast.literal_eval` or structured serializers (JSON).",
         0.95, (("eval", "exec"),)),
    Rule("SEC-005", "security", "high", "Insecure Shell Command Execution (`shell=True` / `os.system`)",
         r"""(?:subprocess\.(?:run|Popen|call)\s*\(.*shell\s*=\s*True|os\.system\s*\()""",
         "Spawning a subshell with `shell=True` or `os.system` exposes the host to command injection vulnerabilities.",
         "Pass command arguments as a list with `shell=False` (e.g. `subprocess.run(['ls', '-l'], check=True)`).",
         0.95, (("subprocess.", "os.system"),)),
    Rule("SEC-006", "security", "high", "Insecure Deserialization (`pickle` / unsafe `yaml.load`)",
         r"""(?:pickle\.loads?\s*\(|yaml\.load\s*\([^,)]*\))""",
         "Unsafe deserialization allows arbitrary code execution when untrusted data is deserialized.",
         "Use `yaml.safe_load(...)` or JSON serialization (`json.loads`) instead of `pickle`.",
         0.95, (".load",)),
    Rule("SEC-007", "security", "medium", "Weak Cryptographic Hash Algorithm",
         r"""hashlib\.(?:md5|sha1)\s*\(""",
         "MD5 and SHA-1 are cryptographically broken and vulnerable to collision attacks. Do not use them for passwords, signatures, or secure integrity checks.",
         "Upgrade to SHA-256 (`hashlib.sha256`), SHA-512, or `bcrypt`/`argon2` for password hashing.",
         0.95, ("hashlib.",)),
]

# Fixed values.
PERFORMANCE_RULES = [
    Rule("PERF-001", "performance", "high", "Blocking `time.sleep` in Async Routine",
         r"""\btime\.sleep\s*\(""",
         "Using synchronous `time.sleep()` inside an `async def` function blocks the entire event loop, halting all concurrent requests.",
         "Replace with `await asyncio.sleep(...)` to allow non-blocking concurrency.",
         0.90, ("time.sleep",), needs_async=True),
    Rule("PERF-002", "performance", "high", "Database Query Inside Loop (Potential N+1 Query Problem)",
         r"""(?i)(?:db\.query|session\.query|select|find_by|get_user|fetch_one|cursor\.execute)\s*\(""",
         "Database query executed inside a loop. This creates an N+1 query bottleneck that scales poorly with dataset size.",
         "Batch queries using `WHERE id IN (...)` or eager load relationships (e.g. `joinedload`).",
         0.90, ("(",), min_loop_depth=1),
    Rule("PERF-003", "performance", "medium", "Nested Loop with Potential Quadratic $O(N^2)$ Complexity",
         r"""for\s+.*\s+in\s+.*:\s*$""",
         "Nested iteration detected over collections. If both collections scale with input size, this introduces $O(N^2)$ time complexity.",
         "Consider using a `set` or `dict` lookup for $O(1)$ constant-time membership checks instead of nested iteration.",
         0.90, ("for", "in", ":"), min_loop_depth=2),
    Rule("PERF-004", "performance", "low", "Repeated Regex Compilation Inside Function",
         r"""\bre\.compile\s*\(""",
         "Compiling regular expressions repeatedly inside a function adds unnecessary CPU overhead on every invocation.",
         "Move `re.compile(...)` to module-level scope so it is compiled once during startup.",
         0.90, ("re.compile",)),
]

# Fixed values.
LOGIC_RULES = [
    Rule("LOGIC-001", "bug_risk", "high", "Mutable Default Argument in Function Definition",
         r"""def\s+\w+\s*\(.*=\s*(?:\[\]|\{\}|set\(\))\s*[\),:]""",
         "Using a mutable default argument (e.g. `[]` or `{}`) creates a shared instance across all function invocations, causing unexpected state mutations across calls.",
         "Use `None` as the default argument (e.g. `items: list = None`) and initialize inside the function body (`if items is None: items = []`).",
         0.92, ("def", "=")),
    Rule("LOGIC-002", "bug_risk", "medium", "Silent / Bare Exception Catch Block",
         r"""^\s*except(?:\s*:\s*(?:#.*)?|\s+Exception\s*:\s*(?:pass|\.\.\.)\s*(?:#.*)?)$""",
         "Catching and silently ignoring all exceptions hides critical errors, bugs, and keyboard interrupts.",
         "Catch specific exceptions (e.g. `except ValueError:`) and log the error (`logger.exception(...)`).",
         0.92, ("except",)),
    Rule("LOGIC-003", "bug_risk", "low", "Comparison using `== None` or `!= None`",
         r"""(?:==\s*None|!=\s*None)""",
         "Comparisons against singletons like `None` should use the `is` or `is not` identity operator instead of equality `==`.",
         "Replace `x == None` with `x is None` (or `x != None` with `x is not None`).",
         0.92, ("None",)),
    Rule("LOGIC-004", "bug_risk", "low", "Shadowing Python Built-in Identifier",
         r"""(?:\bdef\s+|\b)(?:id|type|list|dict|set|str|int|filter|map|input|format)\s*=""",
         "Variable or parameter assignment shadows a Python built-in function or type.",
         "Rename variable to avoid overriding Python built-ins (e.g. `item_id` instead of `id`).",
         0.92, ("=",)),
]

# Fixed values.
QUALITY_RULES = [
    Rule("QUAL-001", "code_quality", "low", "Debug `print()` Statement in Production Code",
         r"""\bprint\s*\(""",
         "Leftover `print()` statements clutter standard output and should be replaced with structured logging.",
         "Use standard logging (`logger.info(...)` or `logger.debug(...)`).",
         0.88, ("print",)),
    Rule("QUAL-002", "code_quality", "info", "Unresolved `TODO` or `FIXME` Comment",
         r"""#\s*(?:TODO|FIXME|XXX|HACK)\b""",
         "New or modified `TODO`/`FIXME` comment found in PR. Ensure pending items are tracked in an issue tracker.",
         "Address the pending task or link to an official issue tracker ticket.",
         0.88, ("#",)),
]

LINE_RULES = SECURITY_RULES + PERFORMANCE_RULES + LOGIC_RULES + QUALITY_RULES

# The one check on a symbol rather than a line; ``{symbol}`` stands for its name.
DOCSTRING_RULE = Rule(
    "DOC-001", "code_quality", "info", "Missing Docstring on Public Symbol", "",
    "Public symbol `{symbol}` does not have a docstring.",
    "Add a brief docstring describing the purpose of `{symbol}`.",
    0.85,
)

RULES_DDL = """
    rule_no INT, rule_id STRING, rule_ord INT, category STRING, severity STRING, title STRING, message STRING,
    suggested_fix STRING, confidence_score DOUBLE, needs_async BOOLEAN, min_loop_depth INT
"""


def numbered(rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """``(rule_no, rule_ord, rule)``: number in the whole list from 1, and order inside the category."""
    seen: dict[str, int] = {}
    out = []
    for no, rule in enumerate(rules, 1):
        seen[rule.category] = seen.get(rule.category, 0) + 1
        out.append((no, seen[rule.category], rule))
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules table, with the docstring check as number 0."""
    rows = [(0, 0, DOCSTRING_RULE)] + numbered(rules)
    return spark.createDataFrame(
        [
            (no, r.rule_id, order, r.category, r.severity, r.title, r.message, r.suggested_fix, r.confidence,
             r.needs_async, r.min_loop_depth)
            for no, order, r in rows
        ],
        RULES_DDL,
    )


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules given by the caller as a table: rule_id, category, severity, title, pattern, message, suggested_fix, confidence, and
    where there are such columns the guards needs_async and min_loop_depth (null: none). They come to the driver
    because they become literals of an expression; ``hit_array`` cuts long lists into chunks."""
    guards = [c for c in ("needs_async", "min_loop_depth") if c in table.columns]
    return [
        Rule(r["rule_id"], r["category"], r["severity"], r["title"], r["pattern"], r["message"], r["suggested_fix"], r["confidence"],
             **{g: r[g] for g in guards if r[g] is not None})
        for r in table.collect()
    ]

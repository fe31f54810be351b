"""Rule tables: markers, filename patterns, content markers, skip and trash names. All lists here are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RISKS = ("Low", "Medium", "High", "Critical")

#: Directory names that a walk prunes; a store folder of the user's own is an argument of the functions.
SKIP_EXACT = ["node_modules", "target", ".git", ".svn", ".hg", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".cache", "dist", "build", ".idea", ".vscode"]
SKIP_SUFFIX = ".egg-info"

#: kind, name, language
MARKERS = [
    ("file", "Cargo.toml", "Rust"), ("file", "package.json", "JavaScript"), ("file", "go.mod", "Go"),
    ("file", "pyproject.toml", "Python"), ("file", "setup.py", "Python"), ("file", "requirements.txt", "Python"),
    ("file", "pom.xml", "Java"), ("file", "build.gradle", "Java"), ("file", "build.gradle.kts", "Kotlin"),
    ("file", "Gemfile", "Ruby"), ("file", "composer.json", "PHP"), ("file", "CMakeLists.txt", "C++"),
    ("file", "Makefile", None), ("dir", ".git", None),
]
#: Marker names in order of priority for the language; names of a group are equal.
LANGUAGE_LEVELS = [["Cargo.toml"], ["go.mod"], ["pom.xml", "build.gradle", "build.gradle.kts"], ["package.json"], ["pyproject.toml"], ["setup.py"], ["requirements.txt"], ["Gemfile"], ["composer.json"], ["CMakeLists.txt"], ["Makefile"]]

#: kind, pattern, risk, id, label
FILENAME_PATTERNS = [
    ("exact", ".env", "High", "env_file", "Environment file"),
    ("exact", ".env.local", "High", "env_local", "Environment file (local)"),
    ("exact", ".env.production", "Critical", "env_prod", "Environment file (production)"),
    ("prefix", ".env.", "High", "env_prefix", "Environment file (prefixed)"),
    ("exact", "credentials", "High", "aws_credentials", "AWS credentials"),
    ("exact", "credentials", "High", "aws_credentials_path", "AWS credentials"),
    ("suffix", ".pem", "High", "private_key_pem", "Private key (PEM)"),
    ("suffix", ".key", "High", "private_key_key", "Private key"),
    ("exact", "id_rsa", "Critical", "id_rsa", "SSH private key (RSA)"),
    ("exact", "id_ed25519", "Critical", "id_ed25519", "SSH private key (Ed25519)"),
    ("exact", "id_ecdsa", "Critical", "id_ecdsa", "SSH private key (ECDSA)"),
    ("suffix", ".ppk", "High", "ppk", "PuTTY private key"),
    ("suffix", ".p12", "High", "p12", "PKCS#12 keystore"),
    ("suffix", ".pfx", "High", "pfx", "PKCS#12 certificate store"),
    ("suffix", ".jks", "High", "keystore", "Java keystore (JKS)"),
    ("exact", "kubeconfig", "High", "kubeconfig", "Kubernetes kubeconfig"),
    ("exact", "config.json", "Medium", "docker_config", "Docker config"),
    ("exact", ".netrc", "High", "netrc", "netrc credentials"),
    ("exact", ".npmrc", "High", "npmrc", "npm registry config"),
    ("exact", ".pypirc", "High", "pypirc", "PyPI registry config"),
    ("exact", ".git-credentials", "Critical", "git_credentials", "Git credentials"),
    ("exact", "secrets.json", "High", "secrets_json", "Secrets file (JSON)"),
    ("exact", "secrets.yaml", "High", "secrets_yaml", "Secrets file (YAML)"),
    ("exact", "secrets.yml", "High", "secrets_yml", "Secrets file (YAML)"),
    ("contains", "service-account", "High", "service_account", "Service account"),
    ("suffix", "-sa.json", "High", "google_sa", "Google service account"),
    ("exact", ".htpasswd", "High", "htpasswd", "htpasswd credentials"),
    ("contains", "wallet.dat", "Critical", "wallet", "Wallet data"),
]

#: id, kind, pattern, risk, label. The i of a pattern folds case, in Unicode.
CONTENT_MARKERS = [
    ("aws_access_key", "prefix", "AKIA", "Critical", "AWS access key"),
    ("aws_secret_assign", "regex", r"(?i)aws_secret_access_key\s*=\s*\S+", "Critical", "AWS secret access key assignment"),
    ("generic_api_key_assign", "regex", r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*['"]?[A-Za-z0-9_\-]{16,}""", "High", "API key assignment"),
    ("generic_secret_assign", "regex", r"""(?i)(secret|password|passwd|token)\s*[:=]\s*['"]?\S{8,}""", "High", "Secret assignment"),
    ("private_key_header", "regex", r"-----BEGIN[ \t]*(?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "Critical", "Private key (PEM header)"),
    ("github_pat", "prefix", "ghp_", "Critical", "GitHub personal access token"),
    ("github_oauth", "prefix", "gho_", "Critical", "GitHub OAuth token"),
    ("slack_token", "prefix", "xoxb-", "High", "Slack token"),
    ("stripe_live", "prefix", "sk_live_", "Critical", "Stripe live key"),
    ("stripe_test", "prefix", "sk_test_", "Medium", "Stripe test key"),
    ("connection_string", "regex", r"(?i)(postgres|mysql|mongodb)://\S+:\S+@", "Critical", "Database connection string"),
    ("jwt_like", "regex", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "Medium", "JWT-like token"),
]

#: What every hit of the table above holds somewhere: a sign that is rare in prose, with what stands around it. Begins with one
#: class of signs, so that it runs through a text in a small part of the markers' time. \s is Unicode's, as in them; of the
#: letters here none has a folded form beyond ASCII.
CONTENT_GATE = r"[:=K_.\-](?:(?<=[tdnyTDNY][:=])|(?<=(?U:\s)[:=])|(?<=:)//|(?<=_)|(?<=AK)IA|(?<=b-)|(?<=--)---|(?<=\.)eyJ)"

#: strategy and its patterns, in order
TRASH = [
    ("rust", ["target"]),
    ("node", ["node_modules", ".next", "dist", ".nuxt", "coverage"]),
    ("python", ["__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "*.egg-info", ".ruff_cache"]),
    ("jvm", ["build", ".gradle", ".m2"]),
    ("go", ["vendor"]),
    ("generic", [".cache", "tmp", "temp"]),
]


def risk_rank(risk: str) -> int:
    return [r.lower() for r in RISKS].index(risk.lower())


def markers(spark: SparkSession, extra=()) -> DataFrame:
    """ord, kind, name, hint, level: the default markers, then the user's (kind, name, hint)."""
    level = {n: i for i, group in enumerate(LANGUAGE_LEVELS) for n in group}
    rows = [(i, k, n, h, level.get(n, 999)) for i, (k, n, h) in enumerate([*MARKERS, *extra])]
    return spark.createDataFrame(rows, "ord int, kind string, name string, hint string, level int")


def trash_patterns(strategies) -> list[tuple[str, str]]:
    """strategy and pattern of the requested strategies, in their order."""
    known = dict(TRASH)
    unknown = [s for s in strategies if s.lower() not in known]
    if unknown:
        raise ValueError(f"unknown strategies: {unknown}")
    return [(s.lower(), p) for s in strategies for p in known[s.lower()]]

"""Fixed values of the engine: words and weights that results depend on. Plain data, kept together."""

# Relation types and how much each weighs when relations compete.
RELATION_PRIORITY = {
    "is_a": 68, "depends_on": 80, "requires": 78, "builds_on": 76, "runs_on": 74, "uses": 70, "provides": 66, "stores": 64,
    "hosts": 62, "manages": 60, "supports": 58, "exposes": 56, "contains": 54, "includes": 52, "creates": 50, "accesses": 48,
    "allows": 46, "extends": 42, "has": 30, "is_managed_by": 28,
}

# Other spellings of relation types.
RELATION_ALIASES = {
    "built_on": "builds_on", "create": "creates", "created_by": "creates", "depends": "depends_on", "depends upon": "depends_on",
    "is": "is_a", "is_an": "is_a", "is_type_of": "is_a", "managed_by": "is_managed_by", "provide": "provides", "require": "requires",
    "run_on": "runs_on", "used_by": "uses", "utilizes": "uses",
}

# Canonical entity names by lower-case spelling.
ENTITY_ALIASES = {
    "ceph": "Ceph", "k8s": "Kubernetes", "kubernetes": "Kubernetes", "mysql": "MySQL", "mikrotik": "MikroTik", "neo4j": "Neo4j",
    "nginx": "NGINX", "ocp": "OpenShift", "openshift": "OpenShift", "openshift container platform": "OpenShift",
    "operatorhub": "OperatorHub", "odf": "ODF", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "red hat": "Red Hat",
    "red_hat": "Red Hat", "rhel": "RHEL", "routeros": "RouterOS", "scc": "SCC", "terraform": "Terraform", "wireguard": "WireGuard",
    "yaml": "YAML",
}

# Names that are no entities.
ENTITY_NOISE = (
    "admin", "admin_user", "application", "applications", "container", "containers", "cpu", "deployment", "developer_user", "groups",
    "hello_pod", "memory", "network", "oc", "oc_adm", "oc_describe_node", "oc_login", "pod", "pods", "project", "route", "secret",
    "secrets", "service", "storage", "traffic", "user", "users",
)
ENTITY_LOWER = ("of", "and", "for", "the", "to")
ENTITY_UPPER = ("api", "dns", "http", "https", "ip", "rbac", "scc", "tls")

# Stop words of chunk search, of the gate and of graph search.
SEARCH_STOP = ("and", "are", "czy", "dla", "for", "jak", "jest", "kto", "mowi", "mówi", "oraz", "the", "with", "wczoraj")
GATE_STOP = ("and", "are", "czy", "dla", "for", "jak", "jest", "jaki", "jaka", "jakie", "kto", "mowi", "mówi", "oraz", "się", "sie", "the", "with", "wczoraj")
GRAPH_STOP = ("about", "auto", "backend", "czy", "dla", "from", "jak", "jest", "oraz", "pod", "the", "with", "what", "when", "where", "który")

# What a query word is expanded to. Words for a deployment's own project are passed in by the caller.
QUERY_ALIASES = {
    "konstytucja": ("konstytucja", "konstytucji", "constitution"),
    "openwebui": ("openwebui", "open", "webui"),
    "sejmie": ("sejm", "sejmie", "sejmu"),
}

# Words and phrases that mark kinds of queries.
CURRENT_WORDS = ("aktualnie", "cena", "dzisiaj", "dziś", "kurs", "mecz", "najnowsze", "ostatni", "pogoda", "teraz", "wczoraj", "wygrał", "wygral", "wynik")
CONCEPT_PHRASES = ("co to", "czym jest", "jak działa", "wytłumacz", "wyjaśnij", "explain", "what is", "how does")
CODE_WORDS = ("kod", "code", "python", "plik", "file", "funkcja", "function", "class", "debug", "błąd", "error")
LEGAL_WORDS = ("konstytucja", "konstytucji", "minister", "ministra", "obrony", "ustawa", "ustawy", "ustawach", "bezpieczeństwa", "bezpieczenstwa")
LEGAL_TAGS = ("constitution", "polish_law", "law", "legislation")
CURRENT_PATTERNS = (
    r"\b(wczoraj|dzisiaj|dziś|teraz|aktualnie|najnowsz\w*|ostatni\w*)\b",
    r"\b(kto|co|jaki|jaka|jakie)\s+(wygrał|wygral|wygrała|wygrala)\b",
    r"\b(mecz|wynik|score|liga|turniej|wybory|kurs|cena|pogoda)\b",
)
CURRENT_SOURCES = ("current", "live", "news", "sports", "weather", "market", "finance")

# Base forms, and endings that may be cut off.
BASE_FORMS = {
    "bezpieczeństwa": "bezpieczeństwo", "bezpieczenstwa": "bezpieczenstwo", "sejmie": "sejm", "sejmu": "sejm", "sejmem": "sejm",
    "konstytucji": "konstytucja", "konstytucją": "konstytucja", "ministra": "minister", "ministrem": "minister", "obrony": "obrona",
    "narodowej": "narodowa", "prezydencie": "prezydent", "prezydenta": "prezydent", "ustawach": "ustawa", "ustawie": "ustawa",
    "ustawy": "ustawa",
}
ENDINGS = ("owie", "ami", "ach", "ego", "emu", "owi", "iej", "ie", "em", "om", "ą", "ę", "u", "a", "y")

# Tags that commands in a text stand for.
COMMAND_TAGS = (
    (r"\boc\s+", ("openshift", "kubernetes", "cli")),
    (r"\bkubectl\s+", ("kubernetes", "cli")),
    (r"\bdocker\s+", ("docker", "containers", "cli")),
    (r"\bpodman\s+", ("podman", "containers", "cli")),
    (r"\bansible-playbook\b|\bansible\s+", ("ansible", "automation", "cli")),
    (r"\bsystemctl\s+", ("linux", "systemd", "cli")),
    (r"\bhelm\s+", ("helm", "kubernetes", "cli")),
    (r"\bterraform\s+", ("terraform", "iac", "cli")),
    (r"openshift|rhocp|ocp", ("openshift", "kubernetes")),
    (r"kubernetes", ("kubernetes",)),
)

# Technical tags by keyword, words of other subjects, and signs of code, for question-answer pairs.
TECH_TAGS = {
    "ansible": ("ansible", "playbook"),
    "awk": ("awk",),
    "bash": ("bash", "shell", "skrypt", "script"),
    "ceph": ("ceph",),
    "docker": ("docker", "compose", "container", "kontener"),
    "fastapi": ("fastapi",),
    "git": ("git", "github", "gitlab"),
    "kubernetes": ("kubernetes", "kubectl", "pod", "pods", "deployment", "service", "ingress"),
    "linux": ("linux", "systemctl", "journalctl", "ssh", "sudo", "grep", "sed", "chmod", "chown"),
    "networking": ("dns", "tcp", "udp", "ip route", "firewall", "vlan", "network", "sieci", "ssh"),
    "openshift": ("openshift", "oc ", "odf", "operator", "route"),
    "postgres": ("postgres", "postgresql", "pgvector"),
    "python": ("python", "pip", "venv", "django", "flask"),
    "rag": ("rag", "embedding", "vector", "llm", "ollama"),
    "security": ("tls", "ssl", "cert", "oauth", "keycloak", "security"),
    "sql": ("sql", "select", "insert", "update", "delete", "join", "database", "baza danych"),
    "storage": ("storage", "disk", "lvm", "nfs", "iscsi", "s3"),
}
OTHER_SUBJECTS = (
    "angielski", "gramatyka", "wakacje", "film", "piosenka", "jedzenie", "przepis", "samochód", "auto", "rower", "zakupy", "telefon",
    "zdjęcie", "miłość", "randka", "pogoda", "hotel", "lot", "bilet",
)
CODE_SIGNAL = r"(```|\b(select|kubectl|docker|oc|ssh|awk|grep|systemctl|curl|ansible|python|pip)\b|[{};=|])"

# HTML elements without content for readers, elements that break lines, and names of page furniture.
HTML_SKIPPED = ("script", "style", "noscript", "svg", "canvas", "iframe", "form")
HTML_FURNITURE = ("nav", "header", "footer", "aside")
HTML_BLOCKS = ("article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "p", "pre", "section", "table", "td", "th", "tr")
HTML_NOISE = r"(nav|navbar|menu|sidebar|toc|breadcrumb|footer|header|cookie|advert|banner|promo|search|pagination|feedback|edit-this-page)"
HTML_MAIN = ("main", "content", "article", "doc", "markdown")
HTML_NOISE_LINES = ("next", "previous", "prev", "edit", "search", "menu", "copy")
NO_PAGE = r"(?i)\.(png|jpe?g|gif|webp|svg|ico|css|js|zip|tar|gz|pdf|mp4|mp3)$"

# Languages of code files by ending.
CODE_ENDINGS = {
    ".py": "python", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".sql": "sql", ".sh": "shell", ".bash": "shell",
    ".ps1": "powershell", ".bat": "batch", ".cmd": "batch", ".tf": "terraform", ".md": "markdown",
}

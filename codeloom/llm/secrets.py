"""Credentials embedded in source code and configuration: where they stand, and a copy without them."""

from __future__ import annotations

import base64
import binascii
import re
import string

import ahocorasick

#: What stands in a redacted copy instead of a secret: a plain word, so that YAML, TOML, JSON, URLs and code parse as before.
REDACTED = "REDACTED"

# Published formats of access tokens.
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[\w-]{10,}"
    r"|npm_[A-Za-z0-9]{36}|pypi-[\w-]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|ya29\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9_/+-])"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?P<body>(?:\\[nr]|[\s\"'+#*,/>;\\-]){1,40}?[A-Za-z0-9+/=]{16}.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\Z)", re.S)
# What a line with a credential holds at least one of, in lower case.
TRIGGERS = (
    "pass pwd secret token key cred psk auth bearer login signature sig= @ akia asia aiza ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat sk_live sk_test rk_live rk_test xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- npm_ pypi- sg. hf_ dop_v1 ya29 eyj"
).split() + ["connect", "logon", "log_on", "signin", "sign_in", "basic", "identified", "-u ", "-u=", "--user", '="', "='", "=`", "=\n", "code="]

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_PLACE = re.compile(
    r"(?i)^(?:|\$.*|%.*|#.*|.*\$\{.*|.*\{\{.*|.*<[\w -]+>.*|\{.*\}|\[.*\]|@.*|[*•x.?_-]{3,}|.*\*{4,}.*|change[-_ ]?me.*|change[-_ ]?it|replace[-_ ]?.*|your[-_ ].*|my[-_]?(?:password|secret|token)|(?:fake|dummy)[-_].*|(?:example|sample|dummy|fake|test|todo|fixme|placeholder|redacted|masked|hidden|removed|none|null|nil|undefined|true|false|yes|no|on|off|empty|unset|default|auto|disabled|enabled|required|optional|password|passwd|secret|token)"
    r"|(?:vault|file|env|secret|secrets|ref\+?\w*|op|ssm|kms|aws|gcp|azure|keyring|arn|sops|akv|config)(?::|://).*|\d+(?:\.\d+)?(?:ms|us|ns|s|m|h|d|w|y|kb|mb|gb|k|%)?|sha\d+[-:].*|md5[-:].*|data:.*|(?:hs|rs|es|ps)\d{3}|(?:sha|aes|rsa|md)-?\d+(?:-\w+)*|(?:~|\.{1,2})/.*|/(?:run|etc|var|opt|usr|home|mnt|tmp|app|data|srv|secrets?|root|dev|proc|config|keys|certs?|ssl)/.*|process\.env.*|os\.environ.*|getenv.*|https?://[^@]*)$"
)
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$")
_HASHED = re.compile(r"^\$(?:2[aby]?|5|6|argon2\w*|pbkdf2[\w-]*|y)\$|^\{S?SHA\}")
_HASH = re.compile(r"(?i)^(?:0x)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")

# Words of names that hold credentials, and words that make a name speak about one.
CREDENTIAL = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "creds", "psk", "pass", "accesskey", "secretkey", "authtoken", "passwords", "secrets", "authkey"}
KEYS = {"api", "access", "private", "signing", "encryption", "secret", "master", "account", "shared", "auth", "service", "session", "ssh", "tls", "deploy", "license", "storage", "crypto", "hmac", "aes", "jwt", "webhook", "client", "app", "cipher", "integration", "subscription"}
ABOUT = {"label", "hint", "type", "field", "name", "url", "uri", "path", "file", "ttl", "expiry", "expires", "expiration", "length", "min", "max", "count", "limit", "policy", "regex", "pattern", "placeholder", "title", "message", "error", "prompt", "column", "help", "text", "format", "algorithm", "public", "verify", "digest", "hash", "checksum", "integrity", "commit", "icon", "enabled", "required", "strength", "reset", "timeout", "prefix", "suffix", "ref", "arn", "version", "tokenizer", "tokens", "dir", "location", "rotation", "page", "next", "count"}
BEFORE = {"public", "verify", "next", "page", "csrf", "xsrf", "has", "is", "no", "continuation", "cancellation", "cancel"}
# What else stands in names written without separators, and in values that only speak of credentials.
AFFIXES = {"key", "db", "smtp", "eu", "us", "main", "old", "new", "prod", "dev", "ro", "rw", "x"}
SPOKEN = CREDENTIAL | KEYS | ABOUT | BEFORE | {"key", "keys", "bearer", "basic", "oauth", "enter", "code", "value", "data", "user", "username", "login", "store", "manager"}
_GLUED = re.compile(r"password|passwd|passphrase|apikey|accesskey|signingkey|encryptionkey|privatekey|authtoken|privatetoken|accesstoken|clientsecret|(?:db|smtp)pass")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def unglued(word: str, words: frozenset[str]) -> list[str] | None:
    """A name without separators as words, the fewest that spell all of it (Viterbi); None if nothing does."""
    n = len(word)
    best: list[list[str] | None] = [[]] + [None] * n
    for i in range(1, n + 1):
        for j in range(max(0, i - 16), i):
            part = word[j:i]
            if best[j] is not None and (best[i] is None or len(best[j]) + 1 < len(best[i])) and (part in SPOKEN or part in AFFIXES or (i - j >= 4 and part in words)):
                best[i] = [*best[j], part]
    return best[n]


def credential_name(name: str, words: frozenset[str] = frozenset()) -> bool:
    """Whether a name says that its value is a credential, not something about one."""
    parts: list[str] = []
    for w in _SPLIT.findall(name):
        w = w.lower()
        parts += (w not in SPOKEN and len(w) > 5 and unglued(w, words)) or [w]
    if not parts or parts in (["authorization"], ["auth", "header"]):
        return bool(parts)
    at = [i for i, w in enumerate(parts) if w in CREDENTIAL or (w == "key" and i and parts[i - 1] in KEYS) or _GLUED.search(w)]
    return bool(at) and not any(w in ABOUT for w in parts[at[-1] + 1 :]) and not any(w in BEFORE for w in parts[: at[0]])


def residual(text: str, words: frozenset[str]) -> int:
    """Characters that no dictionary word explains, by Viterbi over each run of letters.

    The cheapest reading of a run takes each letter either as part of a word of at
    least four letters, of the dictionary or of the talk about credentials (a quarter a word) or as unexplained (one a letter). Digits
    and marks other than separators are never explained.
    """
    left = sum(1 for c in text if not (c.isalpha() or c in " -_./:"))
    for run in re.findall(r"[^\W\d_]+", text):
        run = run.lower()
        n = len(run)
        best = [0.0] * (n + 1)
        lost = [0] * (n + 1)
        for i in range(1, n + 1):
            best[i], lost[i] = best[i - 1] + 1, lost[i - 1] + 1
            for j in range(max(0, i - 16), i - 3):
                if best[j] + 0.25 < best[i] and (run[j:i] in words or run[j:i] in SPOKEN):
                    best[i], lost[i] = best[j] + 0.25, lost[j]
        left += lost[n]
    return left


def _printable(b: str) -> str | None:
    try:
        raw = base64.b64decode(b + "=" * (-len(b) % 4), validate=True)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if len(text) >= 4 and text.isprintable() else None


def secret_value(v: str, words: frozenset[str], quoted: bool = True) -> bool:
    """Whether the value of a name that holds credentials is a literal secret: not a placeholder, reference or setting, and not all words.

    Salted hashes of passwords (bcrypt, crypt, argon2, pbkdf2, LDAP) and UUIDs are none.
    Bare hex of a digest's length is one here, as the caller has a name that says so
    (api keys are of that form); where only talk points at it, it is none.
    """
    v = v.strip()
    if len(v) < 5 or _PLACE.match(v) or _UUID.match(v) or _HASHED.match(v) or any(c.isspace() for c in v):
        return False
    left = residual(v, words)
    if v[0] in "/.~\\" and not any(c in "+=" for c in v) and left < 0.3 * len(v):
        return False  # a path
    if not quoted and re.search(r"[()\[\]{}<>,]|::|^\w+(?:\.[A-Za-z_]\w*)+$", v):
        return False  # an expression
    return left >= 2


_Q = r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)"
ASSIGN = re.compile(rf"(?P<name>[A-Za-z_$][\w$.-]*)(?:\"|'|`)?\]?\??\s*(?:(?::\s*[^=\"'`\n,;(){{}}]{{0,40}})?[:+]?=>?|:)\s*(?:new \w+\(|String\(|concat!\(|\\\s*|@|\$|b|u|r|f)?\s*{_Q}")
CALL = re.compile(rf"\b(?:set|with|add|use)[_A-Z](?P<name>\w*)\(\s*{_Q}")
PAIR = re.compile(rf"\(\s*[\"'`](?P<name>[\w.-]+)[\"'`]\s*,\s*{_Q}")
BARE = re.compile(r"(?P<name>[A-Za-z_][\w.-]*)[\"'`]?[ \t]*(?:=|:(?=\s)|:(?=[^\s/:=]{6,}\s*$))[ \t]*(?=(?P<v>[^\s\"'`;|&]+))")
ENV = re.compile(r"(?i)^\s*(?:ENV|ARG)\s+(?P<name>\w+)\s+(?P<v>\S+)\s*$")
URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/:@\"'<>]*:(?P<v>[^\s@\"'<>/]+|[^\s@\"'<>]+)@[\w\[.$-]")
CONNECTION = re.compile(r"(?i)[;\"'?&]\s*(?:password|pwd|accountkey|sharedaccesskey|accesskey|secret|apikey|access key|account key)\s*=\s*(?P<v>[^;\"'\s&]+)")
QUERY = re.compile(r"(?i)[?&](?:sig|signature|token|access_token|api_?key|key|secret|password|pwd|auth|client_secret|code)=(?P<v>[^&\s\"'#]{6,})")
HEADER = re.compile(r"(?i)\b(?P<kind>bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/=_.~-]{8,})")
SQL = re.compile(r"(?i)\b(?:password|identified\s+by|secret)\s+(?:=\s*)?'(?P<v>[^'\n]+)'")
OPTION = re.compile(r"(?i)(?<![\w-])(?:--?(?:[\w-]*?(?:password|passwd|token|secret|api-?key|access-?key|passphrase|pwd)|pass)(?:=|\s+)|-D[\w.]*?\.?(?:password|passwd|pass|secret|key|token|pwd)=|(?:-u|--user)[= ]\s*[\w.@-]+:|sshpass\s+-p\s*)[\"']?(?P<v>[^\s\"']+)")
SAID = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)|pass(?=\s*[:=])|pwd|login|credentials?|creds|secret|token|api[- ]?key|access[- ]?key|key)\b(?:[^\n\"'`=:/]{0,40}?)(?:\s*[:=/]\s*|\s+(?:is|was)\s+)(?:[\w.@-]+\s*[/:]\s*)?[\"'`]?(?P<v>[^\s\"'`,;]{6,})[\"'`.,;)]?")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])")
#: A call that signs in: its last literal may be the password of the one before.
SIGN_IN = re.compile(r"(?i)\b\w*(?:connect|login|log_?on|sign_?in|authenticate|credentials)\w*\((?P<args>[^()\n]*)\)")
_ARGUMENTS = re.compile(r"\A(?:[^\"'`]*(?P<q>[\"'`])(?:(?!(?P=q))[^\\\n]|\\.)*(?P=q)\s*,)+\s*" + _Q.replace("q>", "e>").replace("=q", "=e") + r"\s*\Z")
_LAST = re.compile(r"(?i)(?:password|passwd|pwd|pass|secret|token|key|credentials?|passphrase)(?:[._-]?(?:eu|us|main|old|new|prod|dev|ro|rw|\d+))?$")
_JOINT = re.compile(r"(?P<q>[\"'`])\s*(?:\+|\.{1,2}|&|\|\||\\|\.concat\(|(?P<c>,))?\s*(?P=q)")
#: Calls whose arguments are one literal.
_CONCAT = re.compile(r"\bconcat!\([^()]*\Z|\b(?:concat|CONCAT|Concat)\([^()]*\Z")
#: A line whose literal stands on the next one, and how that begins.
_CONTINUED, _CONTINUES = re.compile(r"(?:[=:(+,]|\.\.?|&|\|\|)[ \t]*\\?\r?\Z|\\\r?\Z"), re.compile(r"\n[ \t]*[bruf@$]?[\"'`]")
_COMMENTED = re.compile(r"^\s*(?://|#|--|\*|/\*|<!--|;|>|rem\b|%|\"\"\"|''')|\s(?://|#|--)\s", re.I)
#: A pass phrase: words of the dictionary and a number.
_PHRASE = re.compile(r"[A-Za-z]{3,}(?:[-_.][A-Za-z]{3,}){2,}[-_.]?\d{2,4}\Z")
#: Extensions in which a value needs no quotes.
PLAIN = {"yml", "yaml", "env", "md", "dockerfile", "properties", "ini", "cfg", "conf", "toml", "sh", "txt", "rst"}


def _joined(line: str) -> tuple[str, list[int] | None]:
    """The line with literals that are split over several read as one, and the place of each character in the line."""
    if not _JOINT.search(line):
        return line, None
    out, at, last = [], [], 0
    for m in _JOINT.finditer(line):
        before = line[: m.start()]
        if (before.count(m["q"]) - before.count("\\" + m["q"])) % 2 == 0:
            continue  # an empty literal, not the end of one and the begin of the next
        if m["c"] and not _CONCAT.search(before):
            continue
        out.append(line[last : m.start()])
        at += range(last, m.start())
        last = m.end()
    out.append(line[last:])
    at += range(last, len(line))
    return "".join(out), at


def line_secrets(line: str, words: frozenset[str], plain: bool) -> list[tuple[int, int, int]]:
    """Spans of the secrets in one line, each with the begin of its credential. plain: values may stand without quotes."""
    joined, at = _joined(line)
    spans: list[tuple[int, int]] = []
    take = lambda m, g="v": spans.append(m.span(g))
    for m in TOKENS.finditer(joined):
        spans.append(m.span())
    for m in URL.finditer(joined):
        if not _PLACE.match(m["v"]) and len(m["v"]) >= 4:
            take(m)
    for pattern in (CONNECTION, QUERY, SQL, OPTION):
        for m in pattern.finditer(joined):
            if secret_value(m["v"], words, quoted=pattern is not OPTION):
                take(m)
    for m in HEADER.finditer(joined):
        if m["kind"].lower() == "basic":
            text = _printable(m["v"])
            if text and ":" in text and not _PLACE.match(text.split(":", 1)[1]):
                take(m)
        elif (re.search(r"\d", m["v"]) or (len(m["v"]) >= 16 and re.search(r"[a-z][A-Z]|^[A-Z]+$", m["v"]))) and residual(m["v"], words) >= 8 and secret_value(m["v"], words):
            take(m)
    commented = bool(_COMMENTED.search(joined))
    for pattern in (ASSIGN, CALL, PAIR):
        for m in pattern.finditer(joined):
            if pattern is PAIR and not _LAST.search(m["name"]):
                continue
            if credential_name(m["name"], words) and secret_value(m["v"], words) and not HEADER.match(m["v"]) and "-----BEGIN" not in m["v"] and "://" not in m["v"]:
                take(m)
    for m in SIGN_IN.finditer(joined):
        if a := _ARGUMENTS.match(m["args"]):
            kinds = sum(bool(re.search(k, a["v"])) for k in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
            if kinds >= 3 and residual(a["v"], words) >= 4 and secret_value(a["v"], words) and "://" not in a["v"]:
                spans.append((m.start("args") + a.start("v"), m.start("args") + a.end("v")))
    if (plain or commented) and "-----BEGIN" not in joined:
        for pattern in (BARE, ENV):
            for m in pattern.finditer(joined):
                if credential_name(m["name"], words) and secret_value(m["v"], words, quoted=False) and "://" not in m["v"] and "-----BEGIN" not in m["v"]:
                    take(m)
        for m in SAID.finditer(joined):
            v = m["v"].rstrip(".,;)")
            kinds = sum(bool(re.search(k, v)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
            if kinds >= 2 and (residual(v, words) >= (4 if re.search(r"\d", v) else 8) or _PHRASE.match(v)) and (re.search(r"\d", v) or re.search(r"[a-z][A-Z]", v)) and secret_value(v, words, quoted=False) and "://" not in v and not _HASH.match(v):
                spans.append((m.start("v"), m.start("v") + len(v)))
    for m in ENCODED.finditer(joined):
        if (text := _printable(m[0])) and (TOKENS.search(text) or any(not _PLACE.match(u["v"]) for u in URL.finditer(text)) or any(secret_value(c["v"], words) for c in CONNECTION.finditer(text))):
            spans.append(m.span())
    if at is None or not spans:
        return [(a, b, a) for a, b in spans]
    out = []
    for a, b in spans:  # back to the line: one span for each part of a split literal
        start = a
        for i in range(a + 1, b + 1):
            if i == b or at[i] != at[i - 1] + 1:
                out.append((at[start], at[i - 1] + 1, at[a]))
                start = i
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


def _trigger_places(text: str, triggers: ahocorasick.Automaton):
    """Where a line has to be looked at: trigger phrases, literals that are split, encoded texts that may hold a credential."""
    low = text.lower()
    if len(low) != len(text):  # a few letters are longer in lower case: only ASCII is folded then
        low = text.translate(_FOLD)
    places = [end - n + 1 for end, n in triggers.iter(low)]
    places += [m.start() for m in _JOINT.finditer(text)]
    for m in ENCODED.finditer(text):
        if (t := _printable(m[0])) and (TOKENS.search(t) or URL.search(t) or CONNECTION.search(t)):
            places.append(m.start())
    return sorted(places)


def find_secrets(text: str | None, plain: bool, words: frozenset[str], triggers: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line from 1, start, end) of every secret in `text`; a private key over many lines counts at its BEGIN line."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            keys.append(m.span("body"))
            found.append((text.count("\n", 0, m.start()) + 1, *m.span("body")))
    line, counted, done = 1, 0, -1
    for at in _trigger_places(text, triggers):
        if at < done:
            continue
        begin = text.rfind("\n", 0, at) + 1
        done = text.find("\n", at)
        done = len(text) if done < 0 else done
        # literals that a line leaves to the next are read with it
        while done < len(text) and _CONTINUED.search(text, max(begin, done - 40), done) and _CONTINUES.match(text, done):
            done = text.find("\n", done + 1)
            done = len(text) if done < 0 else done
        line += text.count("\n", counted, begin)
        counted = begin
        whole = text[begin:done].rstrip("\r")
        if "\n" in whole:
            whole = re.sub(r"\\?\r?\n", lambda m: " " * len(m[0]), whole)
        for a, b, first in line_secrets(whole, words, plain):
            a, b, first = a + begin, b + begin, first + begin
            if not any(x < b and a < y for x, y in keys):
                found.append((line + text.count("\n", begin, first), a, b))
    return found


def redact(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """`text` with the found spans replaced and everything else unchanged."""
    if not text or not found:
        return text
    merged: list[list[int]] = []
    for _, a, b in sorted(found, key=lambda x: x[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, last = [], 0
    for a, b in merged:
        out += [text[last:a], REDACTED]
        last = b
    return "".join([*out, text[last:]])


def is_plain(path: str | None) -> bool:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] in PLAIN

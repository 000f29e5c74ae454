"""Personal data in texts: detectors, masks and fingerprints, on plain Python strings.

Offsets count code points. Detectors give spans (type, start, end, match, confidence). The Spark side is in
millrace.operators.guard, which runs these in Arrow batches; what built-ins can express is there as columns.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple
from urllib.parse import unquote_to_bytes


class Span(NamedTuple):
    type: str
    start: int
    end: int
    match: str
    confidence: float


# Classes of signs, patterns, words and weights that results depend on.
_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_SEP = rf"{_WS}*[-.@_*]?{_WS}*"
_MUST = rf"{_WS}*[-.@_*]{_WS}*"


def _digits(low: int, high: int | None = None) -> str:
    """That many digits with white space between them allowed."""
    more = low - 1 if high is None else f"{low - 1},{high - 1}"
    return rf"[0-9](?:{_WS}*[0-9]){{{more}}}"


PATTERNS = {
    "rrn": rf"\b{_digits(6)}{_SEP}[1-4](?:{_WS}*[0-9]){{6}}\b",
    "bank_acct": rf"\b{_digits(2, 4)}{_MUST}{_digits(2, 6)}{_MUST}{_digits(4, 8)}\b",
    "phone_kr": rf"\b0{_WS}*1{_WS}*[016789]{_SEP}{_digits(3, 4)}{_SEP}{_digits(4)}\b",
    "credit_card": rf"\b{_digits(4)}{_SEP}{_digits(4)}{_SEP}{_digits(4)}{_SEP}{_digits(4)}\b",
    "email": rf"\b[A-Za-z0-9._%+-]+{_WS}*@{_WS}*[A-Za-z0-9.-]+{_WS}*\.{_WS}*[A-Za-z]{{2,}}\b",
}
POSITIVE = {
    "rrn": ["주민", "주민번호", "주민등록", "신원", "인증", "KYC", "신용평가"],
    "bank_acct": ["계좌", "입금", "송금", "잔액", "은행", "이체", "신한", "국민", "농협", "우리"],
    "phone_kr": ["휴대폰", "전화", "연락처", "번호", "SMS", "알림", "핸드폰", "문자"],
    "credit_card": ["카드", "결제", "결재", "카드번호", "신용카드", "자동결제"],
    "email": ["이메일", "email", "메일", "주소"],
}
NEGATIVE = {
    "bank_acct": ["시가총액", "매출", "영업이익", "CUSIP", "ISIN", "주문번호", "거래번호"],
    "phone_kr": ["시가총액", "종가", "거래번호", "체결"],
    "credit_card": ["주문번호", "거래번호", "식별자", "CUSIP", "ISIN"],
    "email": ["github", "git@", "SSH", "저장소", "repo"],
}
PRIORITY = {"rrn": 5, "credit_card": 4, "phone_kr": 3, "email": 3, "bank_acct": 2, "demographic": 1}
BASE, BOOST, PENALTY, LEAST, NEAR = 0.85, 0.10, 0.40, 0.50, 20
KOREAN = {"공": "0", "영": "0", "령": "0", "일": "1", "이": "2", "삼": "3", "사": "4", "오": "5", "육": "6", "륙": "6", "칠": "7", "팔": "8", "구": "9"}
UNICODE_DIGITS = {c: str(i % 10) for run in ("０１２３４５６７８９", "⓪①②③④⑤⑥⑦⑧⑨", "〇一二三四五六七八九") for i, c in enumerate(run)} | {"零": "0"}
ENGLISH = {"zero": "0", "oh": "0", "o": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Context words of the first classifier of digit runs, and of the second.
CONTEXT_A = {"rrn": "주민|주민번호|주민등록|RRN|신원|KYC", "bank_acct": "계좌|은행|입금|송금|이체|잔액", "phone_kr": "휴대폰|핸드폰|전화|연락처|SMS|알림", "credit_card": "카드|신용카드|결제|자동결제"}
CONTEXT_B = {
    "rrn": rf"주민|주민등록|RRN|신원|KYC|생년월일|뒤{_WS}*7{_WS}*자리",
    "bank_acct": "계좌|은행|입금|송금|이체|잔액|bank|account",
    "phone_kr": "휴대폰|핸드폰|전화|연락처|SMS|알림|phone|mobile|tel",
    "credit_card": "카드|신용카드|결제|자동결제",
}
LENGTHS = {"credit_card": (13, 19), "bank_acct": (10, 14), "rrn": (13, 13), "phone_kr": (10, 11)}
DEMOGRAPHIC = [
    rf"(?:서울{_WS}*)?강남구{_WS}*역삼동에?{_WS}*사는{_WS}*[0-9]{{2}}세{_WS}*[가-힣]씨{_WS}*(?:남성|여성)",
    rf"(?:서울{_WS}*)?강남구{_WS}*거주{_WS}*[0-9]{{2}}대{_WS}*(?:초반|중반|후반)?{_WS}*(?:남성|여성){_WS}*[가-힣]씨",
    rf"[0-9]{{4}}년{_WS}*[0-9]{{1,2}}월생{_WS}*(?:남성|여성){_WS}*[가-힣]씨",
    rf"[가-힣A-Za-z0-9]+(?:전자|은행|증권|보험|회사)?{_WS}*다니는{_WS}*[0-9]{{2}}세{_WS}*[가-힣]씨{_WS}*직장인",
]
#: A word that each of these patterns needs.
DEMOGRAPHIC_WORDS = ["강남구", "강남구", "월생", "다니는"]
_K = "공영령일이삼사오육륙칠팔구"
_U = "0-9０-９⓪①②③④⑤⑥⑦⑧⑨零〇一二三四五六七八九"
_E = "zero|oh|o|one|two|three|four|five|six|seven|eight|nine"
_DOT, _AT = "(?:dot|period|점|닷|쩜)", "(?:at|앳|골뱅이)"
HIGH_RISK = "주민|계좌|카드|휴대폰|전화|이메일|PII|개인정보|memory\\.dump|저장된|아까|이전|그대로 출력"
BLOCKED = "저장된 개인정보를 응답에 포함할 수 없습니다. (PII leak prevented.)"
STAGE2_ABOVE = 0.85


def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, re.ASCII | flags)


_PATTERN = {k: _re(v) for k, v in PATTERNS.items()}
_CTX_A = {k: _re(v, re.I) for k, v in CONTEXT_A.items()}
_CTX_B = {k: _re(v, re.I) for k, v in CONTEXT_B.items()}
_KOREAN_RUN = _re(rf"[{_K}](?:[{_K}\-.@_*]|{_WS})*")
_SPACED_EMAIL = _re(rf"\b(?:[A-Za-z]{_WS}*)+(?:\.{_WS}*(?:[A-Za-z]{_WS}*)+)*@{_WS}*(?:[A-Za-z]{_WS}*)+(?:\.{_WS}*(?:[A-Za-z]{_WS}*)+)+\b")
_REVERSED_HINT = _re("역순|거꾸로|뒤집")
_NUMBERISH = _re(rf"[0-9](?:[0-9\-.@_*]|{_WS}){{7,}}[0-9]")
_DEMOGRAPHIC = [_re(p) for p in DEMOGRAPHIC]
_URL = _re(r"\b[A-Za-z0-9%._+-]*(?:%[0-9A-Fa-f]{2})[A-Za-z0-9%._+-]*\b")
_BASE64 = _re(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{12,}={0,2})(?![A-Za-z0-9+/=])")
_UNICODE_RUN = _re(rf"[{_U}](?:[{_U}\-.@_*／/·・,，、－\u200b-\u200d\ufeff]|{_WS})*")
_ENGLISH_RUN = _re(rf"\b(?:{_E})(?:(?:[,.\-_/]|{_WS})+(?:{_E})){{9,}}\b", re.I)
_SPOKEN = _re(rf"\b[A-Za-z0-9]+(?:{_WS}+{_DOT}{_WS}+[A-Za-z0-9]+)*{_WS}+{_AT}{_WS}+[A-Za-z0-9]+(?:{_WS}+{_DOT}{_WS}+[A-Za-z]{{2,}})+\b", re.I)
_PHRASE = _re(rf"(?:주민번호|주민등록|RRN|신원|KYC|생년월일|뒤{_WS}*7{_WS}*자리|계좌(?:번호)?|은행|카드(?:번호)?|신용카드|휴대폰|핸드폰|전화|연락처)[^\n]{{0,96}}", re.I)
_LOCATION, _LIVES = "[가-힣]{2,}(?:구|동)", "(?:거주|사는|주소|프로필|주민|신원)"
#: Hints for any text, and those that need a Korean letter.
_HINTS = [
    _re("[０-９⓪①②③④⑤⑥⑦⑧⑨零〇一二三四五六七八九]"),
    _re(r"[\u200b-\u200d\ufeff]"),
    _re(rf"[a-zA-Z]{_WS}[a-zA-Z]{_WS}[a-zA-Z]{_WS}*[.@]"),
]
_KOREAN_HINTS = [
    _REVERSED_HINT,
    _re(rf"(?:^|[^가-힣])[가-힣]씨(?:{_WS}|$|[^가-힣])"),
    _re(rf"[0-9]+{_WS}*(?:년생|세|살|대)"),
    _re(f"{_LIVES}.{{0,12}}{_LOCATION}|{_LOCATION}.{{0,12}}{_LIVES}"),
    _re("다니는|근무|거주"),
]
_DIGIT = _re("[0-9]")
_HANGUL = _re("[가-힣]")
_SAYS_AT = _re(rf"{_WS}{_AT}{_WS}", re.I)
_OH = _re(r"\boh?\b", re.I)
_LONG_ENGLISH = [w for w in ENGLISH if len(w) > 2]
_WORD = _re("[A-Za-z][a-z]{11,16}")
_HIGH_RISK = _re(HIGH_RISK, re.I)
_TAIL = _re(rf"(?:[\-.@_*]|{_WS})+$")
_DECORATION = r"(?:[,，、.:：;；/／·・－-]|" + _WS + ")+"
_FRAME = _re(f"^{_DECORATION}|{_DECORATION}$")


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(text: str) -> bool:
    """The checksum of 13 to 19 digits."""
    digits = [int(c) for c in only_digits(text)][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _around(text: str, start: int, end: int, width: int) -> str:
    return text[max(0, start - width) : end + width]


def confidence(text: str, kind: str, start: int, end: int) -> float:
    """Of a direct match, from the words around it."""
    near = _around(text, start, end, NEAR)
    c = BASE + BOOST * any(k in near for k in POSITIVE[kind]) - PENALTY * any(k in near for k in NEGATIVE.get(kind, ()))
    if kind == "credit_card" and not luhn(text[start:end]):
        c -= PENALTY
    return min(1.0, max(0.0, c))


def resolve(spans: Iterable[Span]) -> list[Span]:
    """Settles overlaps in order of start, longest first (D02): a span meets the first kept one that it overlaps and takes its place if its
    type ranks higher, then if it is more certain, then if it is longer. The result may still overlap."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda x: (x.start, -x.end)):
        at = next((i for i, k in enumerate(kept) if s.start < k.end and s.end > k.start), None)
        if at is None:
            kept.append(s)
        elif _rank(s) > _rank(kept[at]):
            kept[at] = s
    return kept


def _rank(s: Span) -> tuple:
    return PRIORITY[s.type], s.confidence, s.end - s.start


def mask(text: str, spans: Iterable[Span]) -> str:
    """Spans replaced from right to left."""
    for s in sorted(spans, key=lambda x: -x.start):
        text = f"{text[: s.start]}[REDACTED_{s.type.upper()}]{text[s.end :]}"
    return text


def direct(text: str) -> list[Span]:
    """Direct, spaced and specially separated forms."""
    digits, at = bool(_DIGIT.search(text)), "@" in text
    found = []
    for kind, pattern in _PATTERN.items():
        if not (at if kind == "email" else digits):
            continue
        for m in pattern.finditer(text):
            c = confidence(text, kind, *m.span())
            if c >= LEAST:
                found.append(Span(kind, *m.span(), m[0], c))
    return resolve(found)


def _fits(digits: str, kind: str) -> bool:
    low, high = LENGTHS[kind]
    return low <= len(digits) <= high


def _shape(digits: str) -> str | None:
    if re.fullmatch("01[016789][0-9]{7,8}", digits):
        return "phone_kr"
    return "rrn" if re.fullmatch("[0-9]{6}[1-4][0-9]{6}", digits) else None


def _by_context(digits: str, context: str, words: dict[str, re.Pattern], order: tuple[str, ...]) -> str | None:
    return next((k for k in order if words[k].search(context) and _fits(digits, k)), None)


def classify(digits: str, context: str, raw: str) -> str | None:
    """First classifier of digit runs (D09): shape, then context."""
    kind = _shape(digits) or _by_context(digits, context, _CTX_A, ("credit_card", "bank_acct", "rrn", "phone_kr"))
    return kind or _by_context(digits, raw, _CTX_A, ("credit_card",))


def classify_reversed(digits: str, context: str, raw: str) -> str | None:
    """Context first, then shape."""
    return _by_context(digits, context, _CTX_A, ("credit_card", "phone_kr", "rrn", "bank_acct")) or classify(digits, context, raw)


def classify_loose(digits: str, context: str) -> str | None:
    """Second classifier (D10): other words, another order."""
    return _shape(digits) or _by_context(digits, context, _CTX_B, ("rrn", "phone_kr", "bank_acct", "credit_card"))


def _runs(text: str, pattern: re.Pattern, trim: Callable[[str], str], read: Callable[[str], str], kind: Callable[[str, str, str], str | None], width: int, sure: float) -> list[Span]:
    """Runs of some notation of digits that read as ten or more and get a type."""
    out = []
    for m in pattern.finditer(text):
        raw = trim(m[0])
        digits = read(raw)
        if raw and len(digits) >= 10 and (k := kind(digits, _around(text, m.start(), m.start() + len(raw), width), raw)):
            out.append(Span(k, m.start(), m.start() + len(raw), raw, sure))
    return out


def _tailless(raw: str) -> str:
    return _TAIL.sub("", raw)


def _frameless(raw: str) -> str:
    return _FRAME.sub("", raw)


def _has_korean(text: str) -> bool:
    return not text.isascii() and bool(_HANGUL.search(text))


def korean_numerals(text: str) -> list[Span]:
    """Digits spelled in Korean."""
    if not _has_korean(text):
        return []
    return _runs(text, _KOREAN_RUN, _tailless, lambda r: "".join(KOREAN.get(c, "") for c in r), classify, 24, 0.92)


def spaced_email(text: str) -> list[Span]:
    """E-mail addresses with letters apart."""
    if "@" not in text:
        return []
    return [Span("email", *m.span(), m[0], 0.9) for m in _SPACED_EMAIL.finditer(text) if re.search(_WS, m[0])]


def reversed_numbers(text: str) -> list[Span]:
    """Numbers written backwards, where the text says so."""
    if not _has_korean(text) or not _REVERSED_HINT.search(text):
        return []
    return _runs(text, _NUMBERISH, _tailless, lambda r: only_digits(r)[::-1], classify_reversed, 24, 0.9)


def demographic(text: str) -> list[Span]:
    """Phrases that describe one person."""
    if text.isascii():
        return []
    likely = (p for p, word in zip(_DEMOGRAPHIC, DEMOGRAPHIC_WORDS, strict=True) if word in text)
    return [Span("demographic", *m.span(), m[0], 0.86) for p in likely for m in p.finditer(text)]


def deterministic(text: str) -> list[Span]:
    return resolve([*korean_numerals(text), *spaced_email(text), *reversed_numbers(text), *demographic(text)])


def _decoded_type(decoded: str, context: str) -> str | None:
    kind = classify_loose(only_digits(decoded), context)
    if kind:
        return kind
    plain = direct(decoded)
    return plain[0].type if plain else classify_loose(only_digits(decoded), decoded)


def _from_base64(raw: str) -> str | None:
    body = raw.rstrip("=")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        text = base64.b64decode(body + "=" * (-len(body) % 4)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return None
    return None if not text or re.search("[\x00-\x08\x0e-\x1f]", text) else text


def base64_tokens(text: str) -> list[Span]:
    """Base64 tokens that decode to personal data."""
    out = []
    for m in _base64_runs(text):
        if re.search("[A-Za-z+/]", m[0]) and len(m[0]) % 4 != 1 and (plain := _from_base64(m[0])):
            if kind := _decoded_type(plain, _around(text, *m.span(), 32)):
                out.append(Span(kind, *m.span(), m[0], 0.94))
    return out


def url_tokens(text: str) -> list[Span]:
    """Percent-encoded tokens (D12); a plus sign stays one."""
    if "%" not in text:
        return []
    out = []
    for m in _URL.finditer(text):
        if re.search("%(?![0-9A-Fa-f]{2})", m[0]):
            continue
        try:
            plain = unquote_to_bytes(m[0]).decode()
        except UnicodeDecodeError:
            continue
        if plain and plain != m[0] and (kind := _decoded_type(plain, _around(text, *m.span(), 32))):
            out.append(Span(kind, *m.span(), m[0], 0.94))
    return out


def unicode_digits(text: str) -> list[Span]:
    """Full-width, circled and Chinese digits."""

    def read(raw: str) -> str:
        return "".join(UNICODE_DIGITS.get(c, c if c in "0123456789" else "") for c in raw)

    return _runs(text, _UNICODE_RUN, _frameless, read, lambda d, c, _: classify_loose(d, c), 32, 0.92)


def _named_phrases(text: str) -> Iterable[re.Match]:
    lower = text.lower()
    return _PHRASE.finditer(text) if "rrn" in lower or "kyc" in lower or _has_korean(text) else ()


def _may_speak(text: str) -> bool:
    """Whether an address in words may be there: it needs a word for the dot as well."""
    lower = text.lower()
    return ("dot" in lower or "period" in lower or any(c in text for c in "점닷쩜")) and bool(_SAYS_AT.search(text))


def _may_count(text: str) -> bool:
    """Whether ten digits in words may be there: there are as many words for digits."""
    lower = text.lower()
    n = sum(map(lower.count, _LONG_ENGLISH))
    return n >= 10 or (n + lower.count("o") >= 10 and n + len(_OH.findall(text)) >= 10)


def _base64_runs(text: str) -> Iterable[re.Match]:
    """Tokens that may be Base64 of personal data. A word of up to 17 letters, of which only the first may be large, gives at most nine digits
    (of the bytes of four letters the first is none, but that of the first four) and no at sign."""
    # Such tokens hold no blanks, and most texts have none, which is seen sooner word by word.
    if not any(len(w) > 11 and any(not _WORD.fullmatch(t) for t in _BASE64.findall(w)) for w in text.split()):
        return ()
    return (m for m in _BASE64.finditer(text) if not _WORD.fullmatch(m[0]))


def phrases(text: str) -> list[Span]:
    """Digits spread over a phrase that names what they are."""
    out = []
    for m in _named_phrases(text):
        parts = list(re.finditer("[0-9]{2,}", m[0]))
        digits = "".join(p[0] for p in parts)
        if len(digits) >= 10 and (kind := classify_loose(digits, m[0])):
            start, end = m.start() + parts[0].start(), m.start() + parts[-1].end()
            raw = _frameless(text[start:end])
            out.append(Span(kind, start, start + len(raw), raw, 0.9))
    return out


def spoken_emails(text: str) -> list[Span]:
    """E-mail addresses in words."""
    if not _may_speak(text):
        return []
    out = []
    for m in _SPOKEN.finditer(text):
        plain = re.sub(rf"{_WS}+{_AT}{_WS}+", "@", m[0], flags=re.I)
        plain = re.sub(_WS + "+", "", re.sub(rf"{_WS}+{_DOT}{_WS}+", ".", plain, flags=re.I))
        if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", plain):
            out.append(Span("email", *m.span(), m[0], 0.93))
    return out


def english_digits(text: str) -> list[Span]:
    """Ten or more digits in English words."""

    def read(raw: str) -> str:
        return "".join(ENGLISH.get(w, "") for w in re.split(rf"(?:[,.\-_/]|{_WS})+", raw.lower()))

    if not _may_count(text):
        return []
    return _runs(text, _ENGLISH_RUN, lambda r: r, read, lambda d, c, _: classify_loose(d, c), 32, 0.91)


def contextual(text: str) -> list[Span]:
    """What the second stage finds without a model."""
    encoded = resolve([*base64_tokens(text), *url_tokens(text)])
    return resolve([*encoded, *unicode_digits(text), *phrases(text), *spoken_emails(text), *english_digits(text)])


def escalates(text: str) -> bool:
    """Whether a text hints at obfuscation."""
    korean = _has_korean(text)
    return (
        any(h.search(text) for h in (_HINTS[2:] if text.isascii() else _HINTS))
        or (_may_count(text) and bool(_ENGLISH_RUN.search(text)))
        or (korean and any(h.search(text) for h in _KOREAN_HINTS))
        or ("%" in text and bool(_URL.search(text)))
        or (_may_speak(text) and bool(_SPOKEN.search(text)))
        or (korean and any(sum(c in KOREAN for c in m[0]) >= 3 for m in _KOREAN_RUN.finditer(text)))
        or any(len(re.findall("[0-9]", m[0])) >= 2 for m in _named_phrases(text))
        or any((plain := _from_base64(m[0])) and _decoded_type(plain, plain) for m in _base64_runs(text) if re.search("[A-Za-z+/]", m[0]))
    )


def skips_stage2(text: str, spans: Iterable[Span] | None) -> bool:
    """Nothing to escalate, or something certain found already."""
    return any(s.confidence >= STAGE2_ABOVE for s in spans or ()) or not escalates(text)


def adjudicate(text: str, verdicts: Iterable[dict]) -> list[Span]:
    """Spans from a model's verdicts (D19): found again in the text at their first place; unknown types, invented and repeated ones go."""
    out: dict[tuple, Span] = {}
    for v in verdicts:
        kind, match = str(v.get("type") or "").strip().lower(), v.get("match")
        if kind not in PRIORITY or not isinstance(match, str) or not match or (at := text.find(match)) < 0:
            continue
        try:
            sure = float(v.get("confidence", 0.7))
        except (TypeError, ValueError):
            sure = 0.7
        sure = min(1.0, max(0.0, sure)) if sure == sure and abs(sure) != float("inf") else 0.7
        out.setdefault((kind, at, at + len(match)), Span(kind, at, at + len(match), match, sure))
    return list(out.values())


def detect(text: str) -> list[Span]:
    """All that is found without a model, whatever earlier stages found."""
    return resolve([*direct(text), *deterministic(text), *(contextual(text) if escalates(text) else [])])


def normalise(value: str) -> str:
    return "".join(KOREAN.get(c, c.lower() if re.match("[A-Za-z0-9]", c) else "") for c in value)


def fingerprint(value: str, salt: str) -> str:
    """First 16 hex digits of a keyed hash of the normalised value; empty for nothing."""
    plain = normalise(value)
    return hmac.new(salt.encode(), plain.encode(), hashlib.sha256).hexdigest()[:16] if plain else ""


def seed_values(seed: str | Iterable[str]) -> list[str]:
    """Values of a "name: value, name: value" text, and what is detected in it (D23); of a list, its values as they are."""
    if not isinstance(seed, str):
        return list(dict.fromkeys(v for v in seed if v))
    parts = (p.split(":", 1)[-1].strip() for p in seed.split(","))
    return list(dict.fromkeys([*(p for p in parts if p), *(s.match for s in detect(seed))]))


def leaks(seed: str | Iterable[str], output: str, spans: Iterable[Span], salt: str) -> list[str]:
    """Fingerprints of seed values that stand in the output or equal one of its spans."""
    seen = {fingerprint(s.match, salt) for s in spans} - {""}
    marks = ((v, fingerprint(v, salt)) for v in seed_values(seed))
    return list(dict.fromkeys(f for v, f in marks if f and (v in output or f in seen)))


def guard(text: str, seed: str | Iterable[str] | None = None, stage2: str = "auto", salt: str = "", strict: bool = False, timed_out: bool = False, placeholder: str = BLOCKED) -> dict:
    """The whole guard of a text (D20). stage2: auto, force or skip. timed_out: the second stage gave no answer in time."""
    first, second = direct(text), deterministic(text)
    spans = resolve([*first, *second])
    run = stage2 == "force" or (stage2 == "auto" and not spans and escalates(text))
    third = contextual(text) if run and not timed_out else []
    spans = resolve([*spans, *third]) if run else spans
    leaked = leaks(seed, text, spans, salt) if seed is not None and len(seed) else []
    risky = run and timed_out and bool(_HIGH_RISK.search(text))
    reasons = [f"detected:{','.join(s.type for s in spans)}"] * bool(spans) + ["cross-session-fingerprint-match"] * bool(leaked) + ["stage2-timeout-high-risk"] * risky
    action = "block" if leaked or (risky and strict) else "mask" if spans else "allow"
    return {
        "action": action,
        "masked_text": placeholder if action == "block" else mask(text, spans) if spans else text,
        "detections": spans,
        "stage1": first,
        "deterministic": second,
        "stage2": third,
        "stage2_used": run,
        "stage2_timed_out": run and timed_out,
        "leaked": leaked,
        "reasons": reasons,
    }

"""The registry of 30 personal-data and secret patterns.

Declaration order is precedence: where two families find the same normalised
value, the earlier one keeps it. Every pattern is a literal that compiles in
Java and RE2 alike, apart from the French phone number, whose neighbours are
looked at; ``re2`` spells that one for engines without lookaround.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class PatternSpec:
    name: str
    regex: str
    #: The test that a text must pass for the pattern to be tried at all, one of GATES.
    gate: str = ""
    validator: str | None = None
    identifier: bool = False
    #: The capture group that block mode takes for the value.
    group: int = 0
    re2: str | None = None
    re2_group: int = 0


def _trie(words: list[str], longest_first: bool) -> str:
    """Alternatives that share their beginnings, so that most places in a text fail on one letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [c + _trie(rest, longest_first) for c, rest in sorted(heads.items()) if c]
    if "" in heads:
        parts = [*parts, ""] if longest_first else ["", *parts]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _list(text: str) -> list[str]:
    return sorted({w.strip().replace(" ", ".") for w in text.split(",")})


def _words(text: str, longest_first: bool = False) -> str:
    """Alternatives between word boundaries; a blank stands for any one character. Where one word begins another, the shorter is tried first unless said otherwise."""
    return rf"(?i)\b{_trie(_list(text), longest_first)}\b"


_D = "[0-9]"
_DAY = "(?:3[01]|[12][0-9]|0[1-9])"
_GROUP4 = _D + "{4}\\s*"
_PAIR = "\\s?" + _D + "{2}"
_TRIPLE = "\\s?" + _D + "{3}"
_UUID = "-".join(["[0-9a-f]{8}", *["[0-9a-f]{4}"] * 3, "[0-9a-f]{12}"])
_PHONE = r"(?:0|0033|\+33)\s?[1-9](?:[.\s-]?\d\d){4}"

_HEALTH = """aids, allergie, allergique, antecedent, anxiete, anxiety, arret maladie, assurance maladie, bipolaire, bipolar, cancer, chirurgie,
  clinical, clinique, conge maladie, cpam, depression, diabete, diabetique, diagnosis, diagnostic, disability, disabled, disease, handicap, health,
  health insurance, health record, hiv, hopital, hospital, hospitalisation, illness, incapacite, infection, invalidite, maladie, medical,
  medical insurance, medical leave, medical record, medicament, medication, mental health, mutuelle, oncolog, operation, ordonnance, pathologie,
  patient, prescription, psychiatr, psychiatric, psycholog, psychological, sante, schizophren, securite sociale, sick leave, sida, surgery,
  symptom, symptome, therapeut, therapie, therapy, traitement, treatment, tumeur, vaccin, vaccination, vaccine, vih"""
_BIOMETRIC = """adn, analyse adn, biometr, biometric, chromosome, dna, dna analysis, dna test, empreinte, empreinte digitale, face recognition,
  facial recognition, fingerprint, genetic, genetic profile, genetique, genome, genomic, genomique, geometrie main, hand geometry, iris, palm print,
  profil genetique, reconnaissance faciale, reconnaissance vocale, retinal scan, scan retine, test adn, voice print, voice recognition"""
_POLITICAL = """activist, adherent, affiliation politique, campagne electorale, candidat, candidate, cfdt, cfe cgc, cftc, cgt, comite entreprise, cse,
  delegue syndical, demonstration, electeur, election, fo, fsu, greve, labor union, manifestation, member, membre, militant, parti politique,
  political affiliation, political campaign, political party, protest, representant personnel, shop steward, strike, sud, syndical, syndicat, syndique,
  trade union, union member, union representative, unsa, vote, voter, works council"""
_RELIGIOUS = """agnostic, agnostique, atheist, athee, belief, bouddhisme, bouddhiste, buddhism, buddhist, calvinist, calviniste, catholic, catholique,
  church, confession, croyance, culte, eglise, evangelical, evangelique, faith, hindou, hindouisme, hindu, hinduism, islam, islamic, islamique,
  jehovah witness, jewish, judaism, judaisme, juif, laique, lutheran, lutherien, mosque, mosquee, muslim, musulman, orthodox, orthodoxe, parish,
  paroisse, practicing, pratiquant, prayer, priere, protestant, religieux, religion, religious, secular, sikh, sikhisme, spiritual, spirituel,
  synagogue, temoin jehova, temple, worship"""
_ORIENTATION = """bisexual, bisexuel, coming out, fierte, gay, gay pride, gender fluid, gender identity, genre fluide, heterosexual, heterosexuel,
  homosexual, homosexuel, identite genre, lesbian, lesbienne, lgbt, lgbtq, lgbtqi, lgbtqia, marche des fiertes, non binaire, non binary,
  orientation sexuelle, pansexual, pansexuel, pride, queer, sexual orientation, straight, transgender, transgenre, transsexual, transsexuel"""
_ETHNIC = """african, africain, amerindien, ancestry, arab, arabe, ascendance, asian, asiatique, autochtone, biracial, black, blanc, caucasian, caucasien,
  communaute ethnique, ethnic background, ethnic group, ethnic origin, ethnicity, ethnie, groupe ethnique, hispanic, hispanique, indigenous, latina,
  latino, metis, mixed race, multiracial, native american, noir, origine ethnique, origine raciale, race, racial origin, white"""
_EEO = """african american, afro american, alaska native, american indian, apache, arab american, asian american, black american, cherokee, chicana, chicano,
  chinese american, cuban american, filipino american, guamanian, hawaiian, hispanic american, indian american, iranian american, iroquois,
  japanese american, korean american, lakota, latina american, latino american, mexican american, middle eastern, multiethnic, native american, navajo,
  pacific islander, pakistani american, persian, puerto rican, samoan, sioux, tribal, two or more races, vietnamese american"""
_SALARY = """actions gratuites, avantages en nature, bonus, bspce, bulletin de paie, compensation, equity, espp, fiche de paie, fringe benefits, gross salary,
  income, net salary, paie, pay stub, payslip, pee, perco, prime, remuneration, restricted stock, revenus, rsu, salaire, salaire brut, salaire net,
  salary, stock options, traitement, wage"""
_TAX = """1099, avis d imposition, federal tax, national insurance, nif, nino, numero de contribuable, numero fiscal, numero tva, revenu fiscal, rfr, spi,
  state tax, steuer-id, steueridentifikationsnummer, steuernummer, tax id, tax identification, tax return, taxpayer id, tva intracommunautaire,
  unique taxpayer reference, utr, vat number, w-2"""
_SECRETS = """ANTHROPIC_API_KEY APP_SECRET AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY AZURE_OPENAI_ENDPOINT AZURE_OPENAI_KEY CLIENT_SECRET DATABASE_URL DB_PASSWORD
  DISCORD_TOKEN ENCRYPTION_KEY GITHUB_TOKEN GITLAB_TOKEN GOOGLE_API_KEY GOOGLE_APPLICATION_CREDENTIALS JWT_SECRET NPM_TOKEN OPENAI_API_KEY PRIVATE_KEY
  REDIS_URL SECRET_KEY SENDGRID_API_KEY SESSION_SECRET SLACK_TOKEN STRIPE_PUBLISHABLE_KEY STRIPE_SECRET_KEY TWILIO_AUTH_TOKEN"""
_VENDOR = [
    "gh[oprsu]_[a-z0-9]{36}", "AKIA[a-z0-9]{16}", r"AIza[\w-]{35}", "sk-ant-[a-z0-9-]{32,}", "sk-(?:proj-)?[a-z0-9]{32,}", "sk_(?:test|live)_[a-z0-9]{24,}",
    r"(?:azure_[a-z_]*(?:secret|token|key)|azure_subscription_id|cognitive_service_key|ocp-apim-subscription-key|subscription[_-]?(?:id|key)|api[_-]key)\s*[\s:=" + '"' + r"]\s*" + _UUID,
]

PATTERNS: tuple[PatternSpec, ...] = (
    PatternSpec("email", r"(?i)\b[\w.%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b", "@", identifier=True),
    PatternSpec("iban", rf"(?i)\b[a-z]{{2}}{_D}{{2}}[a-z0-9]{{4}}{_D}{{7}}[a-z0-9]{{0,16}}\b", "digit", "iban"),
    PatternSpec("iban_fr", rf"(?i)fr{_D}{{2}}\s*{_GROUP4 * 5}{_D}{{3}}", "digit", "iban"),
    PatternSpec("phone_fr", rf"(?<!\d){_PHONE}(?!\d)", "digit", identifier=True, re2=rf"(?:^|[^0-9])({_PHONE})(?:$|[^0-9])", re2_group=1),
    PatternSpec("ssn_fr", rf"\b[12]{_PAIR * 3}{_TRIPLE * 2}{_PAIR}\b", "digit", identifier=True),
    PatternSpec("dni_es", rf"(?i)\b{_D}{{8}}[a-hj-np-tv-z]\b", "digit", "dni"),
    PatternSpec("nie_es", rf"(?i)\b[x-z]{_D}{{7}}[a-z]\b", "digit", "nie"),
    PatternSpec("nif_pt", rf"\b[1-35]{_D}{{8}}\b", "digit", "nif"),
    PatternSpec("pesel_pl", rf"\b{_D}{{2}}(?:1[0-2]|0[1-9]){_DAY}{_D}{{5}}\b", "digit", "pesel"),
    PatternSpec("codice_fiscale_it", rf"(?i)\b[a-z]{{6}}{_D}{{2}}[a-ehlmpr-t]{_DAY}[a-z]{_D}{{3}}[a-z]\b", "digit", "codice_fiscale"),
    PatternSpec("niss_be", rf"\b{_D}{{2}}" + rf"[\s.]?{_D}{{2}}" * 2 + rf"[\s.-]?{_D}{{3}}[\s.]?{_D}{{2}}\b", "digit", "niss"),
    PatternSpec("bsn_nl", rf"\b{_D}{{9}}\b", "digit", "bsn"),
    PatternSpec("health_data", _words(_HEALTH, longest_first=True), "keyword"),
    PatternSpec("biometric", _words(_BIOMETRIC), "keyword"),
    PatternSpec("political", _words(_POLITICAL), "keyword"),
    PatternSpec("religious", _words(_RELIGIOUS), "keyword"),
    PatternSpec("sexual_orientation", _words(_ORIENTATION), "keyword"),
    PatternSpec("ethnic_origin", _words(_ETHNIC), "keyword"),
    PatternSpec("eeo_ethnicity", _words(_EEO), "keyword"),
    PatternSpec("gender", r"(?i)(?:gender|genre|sexe?)\s*[=:]\s*(?:autre|f|female|feminin|femme|homme|m|male|man|masculin|other|woman)\b|\b(?:agender|bigender|genderqueer|non.bina(?:ire|ry))\b", "gender"),
    PatternSpec("credit_card", rf"\b(?:3[47]{_D}{{13}}|4{_D}{{15}}|(?:2[2-7]|5[1-5]){_D}{{14}}|6(?:4[4-9]{_D}|5{_D}{_D}|011){_D}{{12}})\b", "digit"),
    PatternSpec("ssn_us", rf"\b{_D}{{3}}(?:\s{_D}{{2}}\s|-{_D}{{2}}-){_D}{{4}}\b", "digit", identifier=True),
    PatternSpec("ein_us", rf"\b{_D}{{2}}-{_D}{{7}}\b", "digit"),
    PatternSpec("itin_us", rf"\b9{_D}{{2}}-{_D}{{2}}-{_D}{{4}}\b", "digit"),
    PatternSpec("salary_data", _words(_SALARY), "keyword"),
    PatternSpec("crypto_wallet", r"\b(?:0x[0-9A-Fa-f]{40}|bc1[0-9A-HJ-NP-Za-z]{39,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", "digit"),
    PatternSpec("tax_id_keyword", _words(_TAX), "keyword"),
    PatternSpec("bank_routing_us", rf"(?i)(?:aba|ach|bank\s*(?:number|code)|routing|wire\s*transfer)\s*[#:=\s]\s*(3[0-2]{_D}{{7}}|[12]{_D}{{8}}|0[1-9]{_D}{{7}})\b", "digit", group=1),
    PatternSpec("api_key", rf"(?i)(?:{'|'.join(_VENDOR)})", "vendor"),
    PatternSpec("secret_env", rf"(?m)(?:^|[;\s])(?:{'|'.join(_SECRETS.split())})\s*=\s*\S+", "="),
)
#: Cheap tests, each passed by every text that a pattern of this gate matches; "keyword" is one pass for nine families.
GATES = {
    "@": "@",
    "digit": "[0-9]",
    "=": "=",
    "gender": r"(?i)\b(?:agender|bigender|genderqueer|non.binair|non.binary)|(?:gender|genre|sexe?)\s*[=:]",
    "vendor": r"(?i)gh[oprsu]_|akia|aiza|sk[_-]|azure_|cognitive_|ocp-|subscription|api[_-]key",
    "keyword": _words(", ".join((_HEALTH, _BIOMETRIC, _POLITICAL, _RELIGIOUS, _ORIENTATION, _ETHNIC, _EEO, _SALARY, _TAX))),
}


def _loose(regex: str) -> str:
    """A pattern for RE2 over bytes (Latin 1) that occurs in every text where Java finds the given one, and in few others.

    Java's word boundaries know all letters, RE2's those of ASCII alone, so they hold wherever Java's do beside an ASCII letter or digit.
    White space has the vertical tab, and a character is up to four bytes.
    """
    out, inside = [], False
    for part in re.findall(r"\\.|\(\?.|.", regex, re.S):
        if part == r"\s":
            part = r"\s\x0b" if inside else r"[\s\x0b]"
        elif part == "." and not inside:
            part = "(?s:.{1,4})"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


_LOOSE_EMAIL = r"(?i)[\w.%+-]@[a-z0-9.-]+\.[a-z|]{2}"  # its ends may be no letters, so its boundaries are left out
_LOOSE_SECRET = rf"(?:{'|'.join(_SECRETS.split())})[\s\x0b]*="  # Java has more ends of lines
#: The loose form of each pattern, by its order.
LOOSE = tuple({"email": _LOOSE_EMAIL, "secret_env": _LOOSE_SECRET}.get(p.name) or _loose(p.re2 or p.regex) for p in PATTERNS)
BY_NAME = {p.name: p for p in PATTERNS}
IDENTIFIERS = tuple(p.name for p in PATTERNS if p.identifier)

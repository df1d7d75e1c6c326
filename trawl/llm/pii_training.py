"""Labelled sentences for the models of problem 9, made from a seed: frames with slots, and the start of each true item."""

from __future__ import annotations

import random
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from trawl.llm.pii import Lexicon

#: Sentences made (a documented bound of the training sample).
SENTENCES = 9_000

# Frames with {person}, {email}, {phone}, {id}, {address}, and frames that hold no personal item. They, the streets, towns and hosts were written for this purpose and stand in none of the
# documents that the project has (a test looks); what the documents say was not used.
_WITH = [
    "{person} noticed this while exporting.", "Please talk to {person} about the import.", "Handed over to {person} on Monday.", "I spoke with {person} and we agree.", "Review requested from {person}", "maintainer: {person}", "contact={person}", "Written by {person}", "Acked-by: {person}",
    "Suggested-by: {person} <{email}>", "Fixed-by: {person} ({email})", "Ping {person}.", "{person} is on leave, write to {person} instead.", "as Mr. {person} told us, nothing changed", "Prof. {person} and Dr. {person} both reproduced it.", "Mrs. {person} phoned support.", "Ms. {person} agrees.",
    "Best,\n{person}", "Kind regards\n{person}\n", "Sincerely,\n{person}", "Cheers,\n{person}", "-- \n{person}", "--\n{person}\n{address}", "{person} wrote:", "From: {person}", "To: {person}, {person}", "| Reporter | {person} |", "name: \"{person}\"", "'assignee': '{person}'", "# TODO({person}): remove this",
    "This was closed by {person} two days ago.", "Many thanks to {person} and {person}!", "Hello {person}, any news?", "The change by {person} is live.", "{person} will look into it tomorrow.", "{person} asked for a rollback.", "It was {person} who found the culprit.", "cc: {person}", "Spotted by {person} in production.",
    "Frau {person} meldet dasselbe.", "Herr {person} schaut sich das morgen an.", "Wir haben {person} informiert.", "Ansprechpartner: {person}", "laut {person} fehlt die Datei", "Danke an {person}!", "Mit freundlichen Grüßen\n{person}", "Erfasst von {person}.", "{person} hat es bestätigt.", "Zuständig ist {person}",
    "Gestern rief Frau {person} an.", "Wie Herr {person} schrieb, geht es nicht.", "Please tell Mr. {person} again.", "Hier encore Mme {person} écrivait.", "Un abrazo, {person}", "Salutations, {person}", "Herzlich, {person}", "Best regards, {person}", "Mme {person} confirme.", "Selon {person}, tout est normal.", "Corrigé par {person}", "Responsable : {person}", "Merci beaucoup {person} !", "Bien à vous,\n{person}", "J'ai parlé avec M. {person}", "{person} a confirmé.", "Voir avec M. {person}.", "Confié à {person}",
    "La señora {person} lo confirma.", "Según {person}, no hay datos.", "Revisado por {person}.", "Responsable: {person}", "Saludos,\n{person}", "Hablé con {person} esta mañana", "Sr. {person}", "{person} lo confirmó.", "Encargado: {person}, {email}", "Agradezco a {person}",
    "{person} さんが確認しました", "負責人：{person}", "作者: {person}", "{person} 提交了补丁", "由 {person} 报告", "{person} 様",
    "Send logs to {email} please.", "<{email}>", "reply-to: {email}", "user {email} is locked out", "E-Mail: {email}", "\"email\": \"{email}\"", "account {email} expired", "notify {email} and {email}", "https://go.blankhost.test/?recipient={email}&lang=en", "Schreiben Sie an {email}.", "Correo: {email}", "Courriel : {email}",
    "メール: {email}", "邮箱：{email}", "mailto:{email}", "commit of {person} <{email}>", "rcpt={email};", "({email})", "My address is {email} since June.", "Mails for {email} come back.", "[{email}]", "owner: {email}, backup: {email}", "Contact {email}, or use the form.",
    "Phone {phone}", "Tel. {phone}", "phone={phone}", "my cell is {phone}", "You may ring {phone} until six.", "fax {phone}", "Text me at {phone}.", "emergency line: {phone}", "Rufen Sie {phone} an.", "Telefon: {phone}", "Tél. : {phone}", "Mi móvil es {phone}.", "{{\"phone\": \"{phone}\"}}", "電話番号 {phone}", "联系电话：{phone}",
    "the hotline ({phone}) is dead", "WhatsApp {phone}", "caller {phone} hung up", "dial {phone} first", "message for {phone} was dropped", "home {phone}, office {phone}", "mobile: {phone}", "tel:{phone}", "Please ring me: {phone}", "{phone}", "to={phone} code=7", "Notruf unter {phone}", "Appelez le {phone}", "Llame al {phone}", "pager={phone}",
    "{idname} {id} was printed in plain text.", "my {idname} is {id}", "{idname}={id}", "{idname} ({id})", "The scan shows {idname}: {id}.", "Please delete {id}, it is my {idname}.", "v = '{id}'  # {idname}", "Ausweisnummer {id}", "DNI {id}", "numéro d'identité {id}", "身份证号 {id}", "パスポート番号 {id}",
    "Sozialversicherungsnummer: {id}", "Pasaporte {id}", "parse(\"{id}\")  # {idname}", "With {id} as {idname} the check passes.", "Entering {idname} {id} twice fails.", "{idname} no. {id}", "Steuernummer «{id}»",
    "My home is at {address}.", "Deliver the parcel to {address}", "We moved to {address} in May.", "office: {address}", "address={address}", "Lieferadresse: {address}", "Zugestellt wird in {address}.", "J'habite {address}", "Vivo en {address}.", "Domicilio: {address}", "住所: {address}", "地址：{address}",
    "Versand an {address} klappt nicht.", "Un colis pour {address} est perdu.", "Return label: {address}", "Find us at {address}, please.", "The invoice goes to {address}.", "No map knows {address}.", "{person}\n{address}\n", "{address}", "\"street\": \"{address}\"", "shipping to {address} takes days", "Anschrift: {address}", "Adresse postale : {address}", "Entrega en {address}", "visit {address} for the demo",
]
_WITHOUT = [
    "The {given} {family} runs out of memory.", "A {given} {family} holds {n} rows.", "the {family} {family} is slow", "Our {given} {family} was rebuilt.", "0x{d6}a at address {d5}", "code_{d3} at startup", "v{d2} at {noun}", "run {d3} at {noun}.{noun}", "name_{d2} at {noun}.core", "error e{d4} at line {d3}",
    "clone git@{noun}.test:{noun}/a.git", "fetch hg@blankhost.test:{noun}", "origin git@blankhost.test:{noun}.git (push)", "svn@{noun}.example:/trunk",
    "{given} Service crashed after {n} requests.", "The {family} Index is rebuilt at night.", "{n} Data Nodes form one Ring.", "Appendix {n} Long Street explains the {noun}.", "{family} Lane is our staging environment.", "We call the {noun} cluster {family} Court.", "{family} Road shipped in March.", "{given} Drive and {family} Street are milestones.",
    "SKU 9{d2}-0{d1}-{d4} is sold out", "batch {d3} {d3} {d3} {d3} failed", "revision {d5}-{d3}-{d2} of the {noun}", "hash 0x{d6}{d2} differs", "rows {d4}-{d5} are skipped", "upgrade {noun}@2.{d1}.{d1} first", "host 198.51.100.{d2} port {d5}", "bind [::1]:{d5} and 172.16.{d2}.7", "Time Out and Read Only are shown.",
    "git clone git@code.blankhost.test:team/{noun}.git", "remote: git@blankhost.test:{noun}/core.git", "use the @{noun}.cached decorator", "2023-1{d1}-0{d1}T11:42:07,{d3} INFO {noun} took={d2}ms", "uuid {d6}ab-{d4}-4{d3}-{d4}-{d6}", "part no. 9{d2}-0{d1}-{d4} was replaced", "article {d3}-{d2}-{d4} in the {noun} list", "shift {d4} {d4} {d4} ended",
    "Null Pointer Exception", "Access Denied", "Internal Server Error", "Pull Request", "Known Issues", "Getting Started", "# Release Plan", "Steps Taken", "Table Of Contents", "Visual Basic", "Internet Explorer", "Apache Kafka uses {n} brokers.", "Hello World", "Merge Conflict and Dead Lock occur.", "Ubuntu Server {n}", "Android Studio", "Amazon Linux", "Windows Update broke the {noun}.",
    "The new {given} Engine keeps {n} entries.", "Our {given} Worker reads the {noun}.", "A {family} Router has {n} ports.", "The {given} Module, the {family} Plugin and the {given} Library load.", "{given} Client: timeout", "{family} Handler is null", "import {given}{family}", "class {given} Parser", "{given}.{family}()", "see {given}{family}.java:{d2}", "at com.{noun}.{given}Reader.read({given}Reader.java:{d3})",
    "{noun}@{noun}.timer is masked", "restart {noun}@{noun}.socket", "We stop at {noun}.org for now.", "look at {noun}.net again", "it ends at {noun}.com", "arrive at {noun}.test", "scp build@{noun}.local:/tmp", "docker run {noun}@sha256:{d6}", "@types/{noun}", "{noun}@latest", "We meet at {noun}.net today.", "look at {noun}.json", "values at org.{noun}.core are stale", "pin {noun}@{d1}.{d1}.{d2}", "the cursor at {noun}.rows is closed", "ISBN 97{d1}-{d1}-{d4}-{d4}-{d1}", "invoice {d3}-{d2}-{d4} is paid", "lines {d3}-{d4}, {d5}-{d5}",
    "build {d5}-{d3}-{d2} is green", "seek to {d6}-{d6}", "slot {d2} {d3} {d3} {d3} is empty", "since 19{d2}-0{d1}-1{d1} {d2}:{d2}", "place {d5}, then {d6}", "{n} of {n} done", "stamped 16{d6}{d2}", "model no. {d3}-{d4}-{d3}", "tracking code {d6}-{d4} is unknown", "ratio {d1}.{d5} {d1}.{d5}", "order no. {d3}-{d3}-{d4}", "ticket {d6}-{d4} is open", "({d3}) {d3}-{d2} items", "range {d4}..{d4}", "seed={d6} step={d5}",
    "Section {n} River Road was removed.", "part {n} Old Court of the handbook", "{n} Open Place holders", "{n} Dead Lane markers", "{family} Lane Street Map", "open the door at once", "meet at noon", "Step One and Step Two", "Der Dienst startet nicht.", "Die Tabelle ist leer.", "Le service ne répond pas.", "El servicio no arranca.", "The service does not start.", "Unit Tests pass", "New York", "Monday Morning", "Last Friday", "Best Effort", "Dear Reviewer", "Hi Team", "Thanks Everyone",
]
_NOUNS = "anchor batch buffer cache channel cipher cursor digest driver epoch feed frame graph header index kernel layer ledger locale marker matrix node offset operand packet parser pool probe queue relay ring router rule scope sensor session shard sink slot socket stream table target task token topic trace tree vector volume widget worker writer zone".split()
_STREETS = "Bramblehurst Copperfield Danehill Everglow Fernleigh Gatwold Hollowby Ivystone Juniperton Kestrelby Larkmead Millbrae Nettlecombe Oakhanger Plumstone Ravelow Silverden Thornwick Umberley Wrenfield".split()
_CITIES = "Aldermoss Brunnthal Castelrosa Dornbach Eastmere Fontblanche Grauburg Hjelmvik Isolabella Kranzfeld".split()
_ENDINGS = ["test", "example", "invalid", "org", "net", "com", "de", "fr", "io", "edu", "co.uk", "dev.example"]
_IDS = ["SSN", "social security number", "national insurance no.", "passport no.", "tax id", "ID card number", "personal identity number"]
_SYLLABLES = "ar bel cor dan el far gil han is jor kel lor mar nor os pel quin ros sef tam ul ver wil yan zel".split()


def _invented(r: random.Random) -> str:
    return "".join(r.choices(_SYLLABLES, k=r.choice((2, 2, 3)))).capitalize()


def labelled(seed: int, lexicon: Lexicon, frames: tuple[list[str], list[str]] = (_WITH, _WITHOUT)) -> list[tuple[str, list[tuple[str, int]]]]:
    """(text, [(type, start)]): sentences with and without items from ``frames``, some of them on lines of a longer text."""
    r = random.Random(seed)
    given, family = [x.capitalize() for x in sorted(lexicon.given)] or ["Orla"], ["-".join(p.capitalize() for p in x.split("-")) for x in sorted(lexicon.family)] or ["Hoxley"]
    digits = lambda n: "".join(r.choices("0123456789", k=n))

    def person() -> str:
        g = r.choice(given) if r.random() < 0.6 else _invented(r)
        f = r.choice(family) if r.random() < 0.6 else _invented(r) + ("-" + _invented(r) if r.random() < 0.1 else "")
        if r.random() < 0.05:
            f = r.choice(["O'", "D'"]) + f
        k = r.random()
        s = f"{f}, {g}" if k < 0.12 else f"{g} {r.choice('ABCDEKLMRST')}. {f}" if k < 0.24 else f"{g[0]}. {f}" if k < 0.34 else f"{g} {r.choice(['van der', 'von', 'ter', 'de la'])} {f}" if k < 0.42 else f"{g} {f}"
        return s.upper() if r.random() < 0.1 else s

    def email() -> str:
        g, f = r.choice(given).lower(), r.choice(family).lower()
        box = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}-{f}", f"{g}{digits(2)}", f"{g[0]}.{f}{digits(2)}", f"{g}.{f}+{r.choice(_NOUNS)}"])
        at = r.choice(["@"] * 8 + ["%40", " (at) ", " [at] ", "(at)", " AT ", " at "])
        worded = at.strip() not in ("@", "%40") and (at == " at " or r.random() < 0.7)
        dot = r.choice([" [dot] ", " (dot) ", " dot "]) if worded else "."
        name = _invented(r).lower() + r.choice(["", "", "", "-" + r.choice(_NOUNS), f".{r.choice(_NOUNS)}"])
        host = dot.join(f"{r.choice(['', '', 'mx.'])}{name}.{r.choice(_ENDINGS)}".split("."))
        s = box + at + host
        return s.upper() if r.random() < 0.08 and dot == "." else s

    def phone() -> str:
        d = digits
        land, area = r.choice(["1", "7", "27", "33", "34", "39", "41", "44", "48", "49", "61", "81", "86", "351", "353", "420"]), d(r.choice([1, 2, 3]))
        tail = r.choice([f"{d(3)} {d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(6)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(4)}"])
        return r.choice([f"+{land} {area} {tail}", f"+{land}{d(10)}", f"+{land} (0){area} {tail}", f"00{land}-{area}-{d(5)}-{d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{land} ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}‑{d(3)}‑{d(4)}"])

    def number() -> str:
        d = digits
        letters = lambda k: "".join(r.choices("ABCEGHJKLMNPRSTX", k=k))
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{letters(2)}{d(6)}{r.choice('ABCD')}", f"{letters(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{letters(r.choice([1, 2]))}{d(7)}", f"{d(6)}-{d(4)}"])

    def address() -> str:
        w, n, c = r.choice(_STREETS), r.randint(1, 399), r.choice(_CITIES)
        k = r.randrange(7)
        kind = r.choice(["Street", "St.", "Road", "Lane", "Drive", "Ave", "Blvd.", "Court"])
        if k == 0:
            s = f"{n} {r.choice('NSEW')}. {w} {kind}, Apt {r.randint(1, 40)}\n{c}"
        elif k == 1:
            s = f"Flat {r.randint(1, 30)}, {n} {w} Road, {c}"
        elif k == 2:
            s = f"{n} {w} {kind}, {c} {digits(5)}"
        elif k == 3:
            s = f"{w}{r.choice(['str.', 'straße', 'gasse', 'weg'])} {r.randint(1, 99)}{r.choice(['', '', 'a', 'b'])}, {digits(5)} {c}"
        elif k == 4:
            s = f"{n} {r.choice(['rue de la', 'chemin du', 'avenue du'])} {w}, {c}"
        elif k == 5:
            s = f"{r.choice(['Calle', 'Avenida', 'Rua'])} {r.choice(['del', 'de', 'das'])} {w}, {n}, {c}"
        else:
            return f"{n} {w} {r.choice(['Road', 'Lane'])}".upper()
        return s

    makers = {"person": ("person_name", person), "email": ("email", email), "phone": ("phone", phone), "id": ("identity_number", number), "address": ("street_address", address)}
    out = []
    for _ in range(SENTENCES):
        gold: list[tuple[str, int]] = []
        text = ""
        if r.random() < 0.4:
            text += r.choice(["The heap is full again.\n", "A remark on style follows.\n\n", "Usage went up to 93 percent. ", "It was done in 8.1s.\r\n", "```\n", "- ", "> "])
        frame = r.choice(frames[0]) if r.random() < 0.62 else r.choice(frames[1])
        frame = frame.replace("{{", "\x01").replace("}}", "\x02")
        at = 0
        while at < len(frame):
            if frame[at] != "{":
                text += frame[at]
                at += 1
                continue
            end = frame.index("}", at)
            slot = frame[at + 1 : end]
            at = end + 1
            if slot in makers:
                kind, make = makers[slot]
                gold.append((kind, len(text)))
                text += make()
            elif slot == "n":
                text += str(r.randint(2, 99_999))
            elif slot[0] == "d":
                text += digits(int(slot[1]))
            else:
                text += {"noun": lambda: r.choice(_NOUNS), "given": lambda: r.choice(given), "family": lambda: r.choice(family), "idname": lambda: r.choice(_IDS)}[slot]()
        text = text.replace("\x01", "{").replace("\x02", "}")
        if r.random() < 0.4:
            text += r.choice(["\nIt stopped with version 4.0.9.", " Nothing else was logged.", "\n\nWhat should be done?", "\n"])
        out.append((text, gold))
    return out

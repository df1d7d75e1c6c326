"""Sentences as bug reports have them, for the tests of problem 9 only: no model is fitted on them."""

WITH = [
    '{person} saw it first on the staging box.',
    'Ask {person} before touching the cache.',
    'Assigned to Dr. {person} for now.',
    'The ticket was reopened by {person} last week.',
    'owner={person}',
    '| contact | {person} |',
    'Tested-by: {person}',
    'Thanks to {person} and {person} for the trace.',
    'Signed-off-by: {person} <{email}>',
    'Reported-by: {person} <{email}>',
    'Author: {person} ({email})',
    'Reported by {person} during the night shift.',
    'As Ms. {person} said on the call, the table is gone.',
    '{person} hat den Fehler zuerst gesehen.',
    'Gemeldet von {person} ({email}).',
    'Bitte Frau {person} fragen.',
    'Demander à M. {person}.',
    'Lo detectó {person} ayer.',
    'Contacto: {person}, {email}',
    '-- \n{person}\n',
    '--\n{person}\n{address}',
    'Regards,\n{person}',
    'Reviewed-by: {person}',
    'Co-authored-by: {person} <{email}>',
    '請 {person} 確認',
    'Hi {person}, can you look?',
    'The patch of {person} was merged.',
    'According to {person}, the cache is cold.',
    '{person} wrote: it is gone',
    'Signalé par {person}.',
    'cc {person}',
    'Vu par {person} ce matin.',
    'Un saludo, {person}',
    'Viele Grüße, {person}',
    'Cordialement, {person}',
    'Gruß, {person}',
    'Asignado a {person}.',
    'Assigné à {person}',
    'Zugewiesen an {person}.',
    'user={email};',
    '({email})',
    'From: {person} <{email}>',
    "Steuer-ID: '{id}'",
    'pasaporte n.º: «{id}»',
    'You can reach me at {email}.',
    'The bounce went to {email}, which is my private box.',
    'login={email} attempt=4',
    '{{"user": "{email}", "ok": false}}',
    'mailto:{email}',
    'https://track.example/open?id=31&to={email}&v=2',
    'cc: {email}; {email}',
    'Rückfragen bitte an {email}.',
    "Merci d'écrire à {email}.",
    'Pueden escribirme a {email}.',
    '連絡先: {email}',
    'Call me on {phone} if the queue stalls again.',
    'On-call phone: {phone}',
    'sms_to={phone} status=failed',
    'tel:{phone}',
    'pager {phone} did not ring',
    'Mobile {phone} / desk {phone}',
    'My number is {phone}, any time.',
    'Llamar al {phone}.',
    'Appeler le {phone}.',
    'Bereitschaft unter {phone} erreichbar.',
    'Teléfono: {phone}',
    '連絡先: {phone}',
    '电话: {phone}',
    'He typed {id} as his {idname} and the parser died.',
    'The form rejects my {idname} {id}.',
    '{idname}: {id}',
    "field slot = '{id}'  # {idname}",
    'I live at {address}, and the map shows a lake.',
    'Ship the dongle to {address}.',
    'The geocoder fails for {address}.',
    'billing_address: {address}',
    'Adresse: {address}',
    'Dirección: {address}',
    'El envío a {address} falla.',
    '{address}',
]
WITHOUT = [
    '{given} Gateway restarts the {noun} every {n} minutes.',
    'The {given} Cache keeps {n} entries per {noun}.',
    '{n} Worker Threads share one {noun} Pool.',
    'Section {n} Merge Lane of the {noun} guide is out of date.',
    '{family} Drive and {family} Court are only the code names of the {noun} releases.',
    'Part no. 9{d2}-0{d1}-{d5} is listed twice in the {noun} export.',
    'order {d4} {d5} {d5} {d5} was queued',
    'Build {d5}-555-{d2} passed, build {d5}-556-{d2} did not.',
    'Error code 0x{d5}ab{d5} at offset {d5}-{d5}-{d5}.',
    'See lines {d5}-{d4} and {d5}-{d5}.',
    'Pinned {noun}@3.{d1}.{d1} and {noun}@7.2.12 in the lock file.',
    'The node at 192.0.2.{d2} answered on port {d5}.',
    'The {noun} listens on [::1]:{d5} and 10.{d2}.{d2}.20.',
    'User Agent and Merge Queue are both null here.',
    'Clone git@forge.example:{noun}/store_layout.git and run the core suite.',
    'Use `@{noun}.send` as a decorator, not `@save`.',
    '2025-0{d1}-1{d1} 21:02:36,{d2} [ui] WARN auger.{noun} - stamp={d5} compute took {d2}.97s',
    'request id 3f2b{d5}fc{d4}-{d2}-{d2}',
    'CI turned red on 2024-0{d1}-1{d1}; before that the suite ran in {d2}.77s.',
    'Der Aufruf von `run()` endet mit RuntimeError, sobald der {noun} leer ist.',
    'Nach dem Update auf 9.{d1}.2 wird der {noun} nicht mehr geladen.',
    'Could we bind the {noun} lazily?',
    'Calling `run()` with an empty {noun} raises KeyError.',
    'Expected: the {noun} is written once. Actual: it is written {n} times.',
    'The new {given} Scheduler drops the {noun}.',
    'Steps To Reproduce',
    'Release Notes',
    'Expected Behavior',
    '## Version Info',
    'Traceback (most recent call last):',
    'The log shows {n} retries at position {d2}.',
    'Serial {d3}-{d2}-{d4} of the {noun} board was replaced.',
    'invoice {d2} {d3} {d3} {d3} was archived',
    'tracking {d3}-{d3}-{d4} belongs to the {noun} shipment',
    'rev {d6}-{d4} of the {noun} branch',
    'The {family} Server holds {n} rows.',
    'Merge Page and Cache Index are stale.',
    '{given} Node answers on port {d5}.',
    '{family} Road is the name of the {noun} release.',
    'npm i {noun}@{d1}.{d1}.{d1}',
    'Chapter {n} Hill Road of the {noun} guide moved.',
    'Our {given} Pipeline stores {n} rows.',
    'Java Script',
    'Visual Studio',
    'Queue {given} Page',
    'KeyError: cannot emit buffer {d5}\n\tat org.bus.{noun}.{given}Writer.patch_tree(ShaleSlot.java:{d5})',
    'Our io wrapper pins the {noun} at {d1}.7.{d1}, so the new {noun} is never loaded.',
    'the {noun} at org.kiln.{noun} is stale',
    'The candidate is at position {d2}.',
    'open the {noun} at example.org or at {noun}.json first',
    'docker pull registry@sha256:{d5}',
    'see {noun}@{noun}.service on the host',
    '@types/{noun} and {noun}@next',
    'ssh deploy@{noun}.internal:/srv',
    'We met at {noun}.example on Monday.',
]

"""The labelled table that the field is trained from: {kind:span} within ordinary sentences, and sentences with none."""

LABELLED = (
    "write to {email:anna dot berg at mail dot example dot com} before noon",
    "reach me at {email:j.doe [at] mail [dot] org} or come by",
    "his address is {email:paul (at) post (dot) net} now",
    "mail {email:info(at)shop(dot)com} for the list",
    "contact {email:lee42[at]mail6[dot]example[dot]com} please",
    "schreib an {email:max punkt muster at web punkt de} heute",
    "email: {email:ana at correo dot es} gracias",
    "ask {email:sales AT firm DOT co DOT uk} about it",
    "send it to {email:b_ray at uni dot edu} soon",
    "from {email:le.42@mail6.example.com} to all",
    "see {email:er.02@mail0.example.com} for that",
    "call {phone:(678) 555-5272} after six",
    "phone {phone:678-555-5272} is hers",
    "tel {phone:555 123 4567} any time",
    "tel. {phone:030 1234567 89} or mail",
    "her number is {phone:(504) 555-2652} at home",
    "call me on {phone:0171 555 0199 12} today",
    "phone: {phone:6785555272} and ask",
    "fax {phone:00 49 30 1234 5678} only",
    "mobile {phone:07700.900.123} works",
    "the {phone:+1 (696) 555-2293} line is open",
    "and {phone:+49 30 901820 55} there",
    "ring {phone:212.555.0147} or {phone:212.555.0148} now",
    "host {ip:10 . 0 . 12 . 7} is down",
    "from ip {ip:192[.]168[.]3[.]44} we saw",
    "server {ip:172(.)16(.)254(.)1} answers",
    "address {ip:203 dot 0 dot 113 dot 9} was blocked",
    "the {ip:173.33.203.46} entry and more",
    "traffic to {ip:8[.]8[.]4[.]4} only",
    "card {card:4111.1111.1111.1111} was used",
    "pay with {card:5500/0000/0000/0004} please",
    "visa {card:4012_8888_8888_1881} ends soon",
    "number {card:3782 822463 10005} on file",
    "card no. {card:6011.1111.1111.1117} expired",
    "the {card:4661320592814900} was there",
    "charged {card:4111 1111 1111 1111} twice",
    "we met in 2019 and 2020 at the lake",
    "version 2.0 of the license applies",
    "licensed under version 3 or 4.0 of it",
    "it cost 12.50 or 1,200 in all",
    "on 2021-03-04 at 10:30 we left",
    "order 7731 has 12 parts of 3 kinds",
    "token = a3f9c2d41b7e8054 is secret",
    "sections 4.2.1 and 10.11.12 differ",
    "pages 100 to 245 of volume 7",
    "a ratio of 0.75 against 1.25 before",
    "the 4040549990366437 entry is only a count",
    "row 81726354 and row 91827364 match",
    "id 550129384756 is not used",
    "look at the dot on the map",
    "he was at home and at work",
    "the red dot at the end of it",
    "point by point we went through",
    "er stand am punkt und ging",
    "3 of 4 came and 17 of 20 stayed",
    "scores were 21-19 18-21 15-12 then",
    "in 1999 2004 and 2012 it rained",
    "from 9 to 5 on days 1 to 5",
    "coordinates 48.85 and 2.35 are close",
    "a 24 7 service with 365 days",
    "isbn 978 3 16 148410 0 is a book",
    "she wrote 5 books and 40 papers",
    "gpl 3 mit 2 bsd 3 apache 2",
    "table 5 | row 9 | cell 12 | sum 26",
    "the and of in to a is that it",
    "one at a time and all at once",
)

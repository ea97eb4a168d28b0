"""Labelled texts for the detector of personal details: made here, from sentences of our own, never taken from data.

A text is put together from frames in which a capital in braces stands for a detail ({N} name, {E} email, {P} phone,
{I} identity number with its label, {A} address, {G} a name of one word) and a small word for something that only looks
like one (a firm, a post, a place, a build number). Frames come from letters, minutes, tickets, notes, signatures,
curricula and address fields.
"""

from __future__ import annotations

import random
import re

GIVEN = "Anna Boris Celia Daniel Elena Felix Gloria Henrik Irene José Kamila Lars Maria Niklas Olga Pedro Quinn Rania Stefan Thea Ulrich Violeta Walid Xenia Yann Zelda Aïsha Björn Chloé Dmitri Éva Françoise Günther Håkon Inès Jürgen Søren Ayumi Kwame Ngozi Ravi Meera Omar Leila Tariq Priya Noah Emma Liam Ava Dev Jack Sofia Tom Amadou Grace Mark April Will Rose Hope Victor Sasha Łukasz Żaneta Şule Çetin Alice Antonio Asha Bruno Carlos Clara David Emily Frank Helen Hugo Ivan James Julia Karen Laura Leo Mina Nora Paul Peter Rita Ruth Samuel Sarah Thomas Wei Adaeze Bartosz Cosima Dragan Eilidh Fumiko Giorgos Hedda Ilse Jovan Kjell Lorcan Mirela Nasrin Oona Pilar Radek Saoirse Tunde Ulla Vasco Wiebke Ximena Yaw Zsófia".split()
ONSET, MID, END = "Bal Cor Dam Fer Gar Hol Jan Kel Lor Man Nor Ost Pal Rud San Tor Ul Val Wes Zan Bren Cal Drei Fros Gran Hess Kron Lind Mor Quar Že Łą Öst".split(), "a e i o u er an el in or".split(), "berg dahl ez ini ko lund mann nen ov quist rup sen son ström ti vic wald ya zen ard eau oni ić ski czyk oğlu".split()
#: Family names that are everyday words as well.
WORDY = "Bank Head Ma Ba Patel Park Price Stone Field Marsh Church King Cook Baker Carpenter Young Long Law Day Page Rivers Banks Story Best Good Early Love Noble Sharp Swift Lane Street Brook Le Li Wu Ng Oh Kim Tan".split()
TWO_PART = "van Dijk,de la Cruz,von Arnim,O’Hara,O'Neill,McAllister,bin Rashid,da Costa,Al-Farsi".split(",")
OTHER_SCRIPT = "Анна Петрова,Иван Соколов,Ελένη Παππά,Νίκος Βλάχος,李明,王小红,山田太郎,김민수,محمد علي,שרה לוי,अनिता शर्मा".split(",")
PLACE = "field ford haven bury mere wick stead dale bridge port".split()
STREETS = "Oak Maple Cedar Mill Chapel Station King’s Queen's Park River Hill Orchard Bishop Harbour Willow Copper Old New North South West Stone Bell Cross Abbey Garden Lower Upper Salt Market Tanner Rose Duke Silver Ferry".split()
SUFFIX = "Labs,Ltd,Inc,GmbH,Group,Holdings,Systems,Bank,Partners,Retail,Energy,Robotics,Health,Logistics,Insurance,Foods,Airways,Motors,Telecom,Press,Publishing,Data,Mutual,Services,Solutions,Works".split(",")
TECH = "Python,Java,Rust,SQL,Kafka,Redis,Docker,Terraform,Postgres,GraphQL,Linux,Go,Ray,Spring Boot,React Native,Power BI,Visual Studio,Google Sheets,Apache Beam,Ruby on Rails,Vertex AI,Delta Lake,Hugging Face,Open Policy Agent,Swift,Julia,Ruby,Node.js,C#".split(",")
THING = "invoice matcher,seat map,stock count,price feed,rota planner,login page,claims form,parcel tracker,tax module,map service,booking engine,mail queue,photo archive,fare table,meter reader,ward list,refund desk,shift board,call router,paywall".split(",")
PEOPLE = "the harbour crew;our night shift;the school board;two vets;the tram depot;the lab in the basement;every branch;the museum staff;the editors;our auditors;the kitchen;the ferry company;parents and pupils;the allotment club".split(";")
TRADES = "Dance Teacher,Bus Driver,Tax Adviser,Forest Ranger,Chef de Partie,Swim Coach,Opera Singer,Truck Mechanic,School Nurse,Piano Tuner,Bank Clerk,Harbour Pilot,Ski Guide,Shop Assistant,Film Editor,Sabbatical Leave,Parental Leave,See Below,Retail Buyer,Bee Keeper,Family Time,Church Organist,Call Centre Agent,Travel Agent,Zoo Keeper,Wine Maker,Voluntary Work,World Trip,Night Porter,Stage Manager,Deputy Head,Language Study".split(",")
FIELDS = "Data,ML,Software,Site Reliability,Machine Learning,Backend,Front-end,Full Stack,Research,Product,Security,Search,Network,Mobile,Platform,Cloud,QA,Database,Web,Computer Vision,Solutions,Technical,Graphic,Test,Systems,AI,DevOps,Analytics,Embedded".split(",")
JOBS = "Engineer,Scientist,Analyst,Manager,Architect,Developer,Designer,Administrator,Consultant,Writer,Specialist,Tester,Eng.,Dev,Engr,Mgr,Admin".split(",")
THINGS_NAMED = "Trade Fair,Safety Week,Long Service Medal,Night Market,Spring Term,Book Club,Service Level,Best Practice,Code Review,Lost Property,Customer Support,First Aid,Tax Return,Opening Ceremony,Morning Post,Harvest Home,Main Street,City Hall,Central Station,Royal Mail,South Pole,Cape Town,Hong Kong,Los Angeles,Rio Grande,San Jose,Mont Blanc,Lake Geneva,River Tay,Isle of Skye,Master Class,Fire Marshal,Forklift Licence,Project Plan,Blue Lagoon,Golden Gate,New York,San Marino,Great Barrier Reef,Black Forest,Grand Canal,Winter Olympics,World Cup,Silver Line,Union Jack,Red Cross,Open Day,Annual Report,Quality Award,Big Bang,Monte Carlo,Santa Fe,Saint Malo,Orient Express,Summer School,Terms of Use,Happy New Year,Good Friday".split(",")

CLOUD = "Amazon Aurora,Google Drive,Azure Functions,Oracle Fusion,Adobe Premiere,Jira Cloud,GitLab Runner,Apple Pay,Cloud Run,Sage Intacct,Final Cut,Office Online".split(",")

#: Sentences of letters, minutes, tickets and notes.
PROSE = """Dear {G}, thank you for the parcel; it came on {date}.
Dear {N}, your table for {n} is booked.
Hi {G}, can you look at the {thing} before lunch?
Hello {N} and welcome to {firm}.
Kind regards, {N}
Best wishes, {G}
Yours sincerely, {N}, {post}, {firm}
Present: {N}, {N} and {N}; apologies from {N}.
{N} opened the meeting at {n} and thanked {people}.
{N} will write to {people} by {date}.
Action for {N}: order more paper for the {thing}.
Mentored {N} through the first winter
Mentored {G} and two trainees
Taught {N} to run the {thing}
Reported to {N}, {post}
Reported directly to {N} and to the board of {firm}
Line manager: {N}
Supervisor: {N}, {post}, {E}
Interviewed {N} about the {thing} for the {named} issue
Handed the keys to {N} on {date}
Took minutes for {N} and {people}
Wrote the {thing} together with {N}
The {thing} was designed by {N} and built by {people}.
Took the {thing} over when Ms {N} left for {firm}
Covered for Dr {N} during the {named}
Met {N} of {firm} to talk about the {thing}
Ref: Mrs {N}
Ref: {N}, {P}
Reference: Mr {N}, {post} at {firm}, {E}
References: {N} ({P}) and {N} ({E})
Referee: {N} – {E}
Name: {N}
Full name: {N}
Name of applicant: {N}
Name: {S}
Contact: {S}, {P}
Patient: {N}, seen on {date}
Signed: {N}
Author: {N}
Photo by {N}
In memory of {N}, who led {people} for {n} years
Quote from {N}: "the {thing} never failed us"
According to {N}, the {thing} saved {n} hours a week.
As {N} put it, {people} had no time to lose.
For questions about the {thing} ring {N} on {P}.
Out of hours: {N} / {P}
Night desk: {N}, phone {P}
Urgent faults go to {N} - {P} - day or night
You can reach me at {E} or on {P}.
Please send the forms to {E} by {date}.
Write to {E}, not to the old address.
Mail {E} for a copy of the {thing} plans
Samples can be had from {E}
Tel.: {P}, fax: {P}
Phone {P} (mornings only)
Mobile {P}; office {P}
WhatsApp {P} or mail {E}
Call me on {P} after {n}.
Please quote {I} in every letter.
My {I} is on the form already.
The clerk noted {I} and let us in.
Vetted for the site; {I}, valid until {year}
Security cleared, {I}, renewed {year}
{I} was copied for the file.
Documents shown: {I}; {I}
On file: {I}
She lives at {A} with two dogs.
Deliver to {A} before noon.
We moved to {A} in {year}.
The shop at {A} is closed on Mondays.
Home address: {A}
Address: {A}
Post to {A}
Send post to: {A}, attn. {N}
The trial was run from {A} for {people}
Meeting point: {A}
Billing address: {N}, {A}
{N}, {A}
{N}, born in {place}, lives at {A}
Paid with card {C}
Card on file {C}, expires 09/{year}
Account {B} at {bank}
IBAN: {B}
Transfer to {B}, reference {code}
Emergency contact: {N}, {P}
Next of kin {N}, {A}, {P}
Visited {N} and {N} in {place}
{N}'s notes on the {thing} were kept.
We thank {N} for lending us the {thing}.
cc: {N}, {N}
From: {N} <{E}>
To: {E}; {E}
{N} <{E}>
{N} ({E})
In the picture, from left: {N}, {N}, {N}
Cast: {N}, {N}, {N}, {N}
Team: {N}; {N}; {N}
Jury: {N}, {N}
To {N}, {N} and {G}
Recruited {N} and {N} from {place}
Replaced {N} as {post}
Succeeded {N} in {year}
Assisted {N}, {post} at {firm}
Thanked {N} and {N} for the {thing}
The poet {N} read for an hour.
Our founder {N} never saw the {thing}.
The old caretaker, {N}, kept the keys.
A portrait of {N} hangs in the hall.
{N} died in {year}.
Two letters by {N} turned up in {place}.
Reporting line: {N}, head of the works
Sold to {N}, {place}
The bill was put on {C}.
Charged to {C} on {date}
{C} was turned down twice.
Deposit taken from {C}, {n} euro""".split("\n")

#: Sentences without any detail, many with things that look like one.
PLAIN = """Rebuilt the {thing} in {tech} for {people}, {n}k lookups an hour
Halved the time the {thing} takes, from {n} to {n} minutes
The {thing} runs on {tech} and {tech} and is used by {people}
On standby for the {thing} and the {thing}, {n} alarms answered
Closed ticket {ticket} in {year}
Fixed bug {ticket} after {people} wrote in
Order {code} was traced from the door to the {thing}
Parcel {code}, {n} kg, left {place} on {date}
Shipment {digits12} reached {people} late
Copied {n} {n3} 000 cards into {tech} over Easter
Moved {n3} {n3} files without losing one
Build {build} went out to {people}
Version {n}.{n}.{n3} of the {thing} was rolled back
Release {n}.{n3}.{n3}.{n} fixed the {thing}
Answered {n} of {n3} calls about the {place} bridge works
Planned the {place} bypass and the {place} tunnel
Published @{word}/{word} as a package for {people}
Follow @{word}{n} for news
Named the two servers {g} and {g} after old ferries
Ran the {g} robot and the {g} pump for {people}
Worked with {firm} on the {thing}
Joined {firm} in {year}, left in {year}
{firm} and {firm} merged on {date}
Invoice {code} and case {ticket} were matched by hand
Practical with {tech}, {tech} and {tech}
Tools: {tech}, {tech}, {tech}
An evening in {place} about {tech}, with talks and cake
Read {named} on the train to {place}
We spent the {named} in {place}.
The {named} exhibition moved from {place} to {place}.
Score {n}-{n} after extra time, {n3} visitors
Open {n}.00 to {n}.30, Monday to Friday
ISBN 978-{n}-{n3}-{code5}-{n}
Serial {serial}, checked in {year}
Room {n3}, floor {n}, building {n}
IP 10.{n}.{n3}.{n} answered within {n} ms
Between {date} and {date} {people} counted {n3} boats.
{year}/{year} was the worst season
From {mm}/{year} to {mm}/{year} nobody used the {thing}
Checked on {mm}/{mm}/{year} and {mm}/{mm}/{year}
Nobody knew who had tried out the {thing} in {year}
It is plain that {people} liked the {thing}.
Senior staff at {firm} asked for a {thing}
Won the {named} for the {thing}
Trained {people} at the {place} works, {n} at a time
Ask at the desk at {n} o'clock
Tea at {n} dot three in the garden
Budget at risk: {n3} 000 in {year}
GPU hours {n3},{n3} at {n} cents
Coordinates {n}.{n3}{n3}, {n}.{n3}{n3}
See {word}.org/{word}/{code5} for pictures
{post} wanted, {place}, start {mm}/{year}
{named} and {named} have a branch each.
{named} has {n} lifts, {named} has {n}.
Received Teacher of the Year in {year}
Passed Grade Eight and Grade Nine in {year}
Voted Shop of the Week by {people}
Chaired Parent Council and School Board
Switched the {thing} to {cloud}
Runs on {cloud} and {cloud}
Software: {tech}, {cloud}, {cloud}
Awards: {named}, {named}""".split("\n")

#: Beginnings and ends of sentences that any detail, and anything that only looks like one, may stand between.
OPENERS = "with,to,by,from,for,and,of,after,before,under,via,at,on,near,about,it was,this is,that was,we asked,they called,then came,he thanked,she met,we saw,nobody knew,all praised,ask,see,try,use,get,find,take,send,leave it with,passed to,shared with,sent to,taken from,given by,left to,written for,walked with,talked to,dined with,bought from,sold by,learned from,checked by,kept by,on behalf of,together with,next to,instead of,not only,even,only,either,both,here is,look for,as for,says,wrote,paired with,sat with,worked for".split(",")
CLOSERS = ",., on Friday, at noon, in the evening, of course, last year, this week, again, too, as well, and others, or so, if need be, once more, after the break, before dawn, for the {thing}, about the {thing}, on the {thing}, in {place}, near {place}, and {people}, for {people}, and {tech}, in {year}, since {year}, until {date}, by {date}, (twice), - urgent, ; see above, : done, / pending, – thanks, was there, went home, has the key, is closed, can help, knows why, says no, came late, answered at once, sings well".split(",")

_ASCII = str.maketrans("áéíóúïüöäåøçèñłąžéšşżğć", "aeiouiuoaaocenlazesszgc")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


class Maker:
    """One labelled text: plain pieces and details, with the details' places."""

    def __init__(self, rng: random.Random):
        self.r, self.text, self.spans = rng, "", []
        self.given, self.last = rng.choice(GIVEN), self.surname()

    # pieces ---------------------------------------------------------------------------------------------------------

    def surname(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.2:
            return r.choice(WORDY)
        if x < 0.25:
            return r.choice(TWO_PART)
        s = r.choice(ONSET) + (r.choice(MID) if r.random() < 0.5 else "") + r.choice(END)
        return s + ("-" + r.choice(ONSET) + r.choice(END) if r.random() < 0.06 else "")

    def digits(self, shape: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "0" else c for c in shape).replace("z", "0")

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHKLMNPRSTXYZ") for _ in range(n))

    def add(self, *parts) -> None:
        for p in parts:
            if isinstance(p, tuple):
                self.spans.append((p[0], len(self.text), len(self.text) + len(p[1])))
                p = p[1]
            self.text += p

    def name(self, given: str = "", last: str = "", style: float = -1.0):
        r = self.r
        g, s, x = given or r.choice(GIVEN), last or self.surname(), r.random() if style < 0 else style
        if style < 0 and r.random() < 0.02:
            return ("name", r.choice([n for n in OTHER_SCRIPT if " " in n and n[0].isupper()]))
        out = f"{g} {s}" if x < 0.55 else f"{g} {r.choice('ABCDEHKMT')}. {s}" if x < 0.65 else f"{g[0]}. {s}" if x < 0.76 else f"{s}, {g}" if x < 0.88 else f"{g} {s}".upper()
        return ("name", out)

    def email(self):
        r = self.r
        g, s = (re.sub(r"[^a-z]", "", w.lower().translate(_ASCII)) or "x" for w in (self.given, self.last))
        user = r.choice((f"{g}.{s}", f"{g}{s}", f"{s}_{g[0]}", f"{s}-{g}", f"{g[0]}.{s}", f"{g}.{s}{r.randrange(10, 99)}", f"{g}+cv", f"{g}{r.randrange(1960, 2005)}"))
        host = r.choice(("mail", "post", "inbox", "uni", "cv", "web")) + "." if r.random() < 0.4 else ""
        host += r.choice("Bal Cor Dam Fer Gar Hol Kel Lor Nor Pal Tor Wes Bren Lind Mor".split()).lower() + r.choice(PLACE) + r.choice(("", "", "-mail")) + "." + r.choice(("org", "com", "net", "test", "example", "invalid", "de", "co", "io", "fr"))
        x = r.random()
        if x < 0.07:
            return ("email", f"{user} @ {host}")
        if x < 0.14:
            return ("email", f"{user}{r.choice(('(at)', '[at]', ' [at] ', ' (at) '))}{host}")
        if x < 0.22:
            at, dot = r.choice((" at ", " [at] ", "[at]", " (at) ")), r.choice((" dot ", " [dot] "))
            return ("email", f"{user.replace('.', dot) if r.random() < 0.6 else user}{at}{host.replace('.', dot)}")
        if x < 0.26:
            return ("email", f"{user} at {host}")
        out = f"{user}@{host}"
        return ("email", out.upper() if x < 0.33 else out.title() if x < 0.37 else out)

    def phone(self):
        r = self.r
        shape = r.choice(("000-000-0000", "(000) 000-0000", "+1 000 000 0000", "+10000000000", "1-000-000-0000", "000.000.0000", "000 000 0000", "+44 20 0000 0000", "+44 (z)0000 000 000", "00000 000000", "+49 30 00000000", "z30 00000 000", "+33 6 00 00 00 00", "z6.00.00.00.00", "000/000/0000", "+00 00 000 00 00", "z00/0000000"))
        return ("phone", self.digits(shape) + (f" x{r.randrange(100, 999)}" if r.random() < 0.05 and "000-" in shape else ""))

    def identity(self):
        """(label, number)."""
        r, k = self.r, self.r.randrange(5)
        if k == 0:
            return r.choice(("SSN ", "SSN: ", "Social security number ")), ("id", self.digits("000-00-0000"))
        if k == 1:
            return r.choice(("passport ", "Passport: ", "Passport no. ", "Passport ")), ("id", self.letters(1) + self.digits("0000000"))
        if k == 2:
            return r.choice(("NI no. ", "NI number: ", "National Insurance ", "NINO ")), ("id", self.letters(2) + self.digits(r.choice((" 00 00 00 ", "000000"))) + r.choice("ABCD"))
        if k == 3:
            return r.choice(("National ID: ", "ID card ", "Identity card ", "ID: ")), ("id", self.digits("000.000.000-00"))
        return r.choice(("Driving licence ", "Licence no: ", "Driver's license ")), ("id", self.letters(5) + self.digits("000000") + self.letters(1) + self.digits("0") + self.letters(1))

    def card(self):
        if self.r.random() < 0.25:
            d = self.digits("37000000000000")
            d += next(str(c) for c in range(10) if luhn(d + str(c)))
            return ("id", self.r.choice((d, f"{d[:4]} {d[4:10]} {d[10:]}")))
        d = self.r.choice("3456") + self.digits("0" * 14)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return ("id", self.r.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))))

    def iban(self):
        land, body = self.r.choice((("DE", self.digits("0" * 18)), ("GB", self.letters(4) + self.digits("0" * 14)), ("NL", self.letters(4) + self.digits("0" * 10))))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        d = f"{land}{check:02d}{body}"
        return ("id", d if self.r.random() < 0.4 else " ".join(d[i : i + 4] for i in range(0, len(d), 4)))

    def place(self) -> str:
        return self.r.choice("Bal Cor Dam Fer Gar Hol Kel Lor Man Nor Ost Pal Rud San Tor Val Wes Bren Cal Gran Lind Mor".split()) + self.r.choice(PLACE)

    def state(self) -> str:
        return self.r.choice(("NY", "CA", "TX", "MA", "WA", "IL", "GA", "CO", "OH", "FL"))

    def address(self):
        r = self.r
        if r.random() < 0.22:
            street = r.choice(("Am Alten Tor", "An Der Aue", "Zur Linde", r.choice(ONSET[:30]) + "straße", r.choice(ONSET[:30]) + "weg", r.choice(ONSET[:30]) + "str.", r.choice(ONSET[:30]) + "allee", r.choice(ONSET[:30]) + "kamp"))
            return ("address", f"{street} {r.randrange(1, 150)}, {r.randrange(10000, 99999)} {self.place()}")
        out = f"{r.randrange(1, 999)}{r.choice(('', '', '', 'A', 'b'))} {' '.join(r.sample(STREETS, r.choice((1, 1, 2))))} {r.choice(('Street', 'St.', 'Road', 'Rd', 'Lane', 'Avenue', 'Ave', 'Drive', 'Close', 'Way', 'Terrace', 'Blvd', 'St', 'Court', 'Row', 'Crescent'))}"
        out += r.choice(("", "", "", f", Flat {r.randrange(1, 60)}", f" #{r.randrange(1, 60)}", f", Unit {r.randrange(1, 60)}", f", Apt {r.randrange(1, 60)}"))
        return ("address", out + r.choice(("", f", {self.place()}", f", {self.place()} {self.state()}", f", {self.place()}, {self.state()} {r.randrange(10000, 99999)}")))

    def company(self) -> str:
        return self.place().replace("port", self.r.choice(("port", "mark", "gate"))) + " " + self.r.choice(SUFFIX)

    def post(self) -> str:
        r = self.r
        t = r.choice(FIELDS) + " " + r.choice(JOBS)
        if r.random() < 0.3:  # what a list of occupations doesn't have
            t = r.choice(TRADES)
        elif r.random() < 0.25:  # mistyped
            i = r.randrange(1, len(t) - 1)
            t = t[:i] + r.choice((t[i] * 2, t[i + 1] + t[i], "", r.choice("aeiurt") + t[i])) + t[i + 1 :]
        t = r.choice(("", "", "", "Senior ", "Lead ", "Junior ", "Staff ", "Sr. ", "Principal ", "Jr ")) + t
        t = r.choice((t, t, t, t, t.upper(), t.lower(), t.replace(" ", "-", 1), " ".join(reversed(t.split(" ", 1))).replace(" ", ", ", 1)))
        return t + r.choice(("", "", "", ", " + self.place(), " (Senior)", " - Jr", " – hybrid"))

    def fill(self, frame: str) -> list:
        """The pieces of a frame."""
        r, out = self.r, []
        month = lambda: r.choice("January February March April May June July August September October November December".split())
        make = {
            "date": lambda: f"{r.randrange(1, 29)} {month()}" + r.choice(("", f" {r.randrange(1998, 2026)}")), "n": lambda: str(r.randrange(2, 99)), "n3": lambda: str(r.randrange(100, 999)), "year": lambda: str(r.randrange(1995, 2028)),
            "mm": lambda: f"{r.randrange(1, 13):02d}", "code": lambda: self.digits(r.choice(("0000000", "00000000", "000000000"))), "code5": lambda: self.digits("00000"), "digits12": lambda: self.digits(r.choice(("000000000000", "00000000000000", "0000 0000 0000 0000"))), "ticket": lambda: self.digits(r.choice(("0000-000-000", "000-000-000", "0000000"))),
            "build": lambda: f"20{self.digits('00')}{r.randrange(10, 13)}{r.randrange(10, 29)}-{self.digits('0000')}", "serial": lambda: self.letters(2) + self.digits("000") + self.letters(2), "thing": lambda: r.choice(THING), "people": lambda: r.choice(PEOPLE), "tech": lambda: r.choice(TECH), "firm": self.company, "bank": lambda: self.place() + " Bank",
            "post": self.post, "place": self.place, "named": lambda: r.choice(THINGS_NAMED), "cloud": lambda: r.choice(CLOUD), "word": lambda: r.choice("maple otter lantern pebble kestrel tundra saffron".split()), "g": lambda: r.choice(GIVEN[:50]),
            "N": self.name, "G": lambda: ("name", r.choice(GIVEN)), "S": lambda: ("name", r.choice(OTHER_SCRIPT)), "E": self.email, "P": self.phone, "A": self.address, "C": self.card, "B": self.iban,
        }
        for i, p in enumerate(re.split(r"\{(\w+)\}", frame)):
            if i % 2 and p == "I":
                out += self.identity()
            elif i % 2:
                out.append(make[p]())
            else:
                out.append(p)
        return out

    # kinds of texts -------------------------------------------------------------------------------------------------

    def mixed(self) -> list:
        """One to three details, or things that look like them, between words that tell little."""
        r = self.r
        held = lambda: r.choice(("{N}", "{N}", "{N}", "{N}", "{P}", "{E}", "{A}", "{I}", "{C}", "{B}") if r.random() < 0.55 else ("{named}", "{named}", "{firm}", "{post}", "{place}", "{tech}", "{cloud}", "{ticket}", "{code}", "{year}", "{date}", "{build}"))
        first = r.choice(OPENERS)
        first = r.choice((first.capitalize(), first, "", f"Notes {first}", f"The {r.choice(THING)} {first}", f"{r.choice(PEOPLE).capitalize()} {first}"))
        more = "".join(r.choice((" and ", ", ", "; ", " or ", " - ", " / ", " on ", f" {r.choice(OPENERS)} ")) + held() for _ in range(r.choice((0, 0, 1, 1, 2))))
        last = r.choice(CLOSERS)
        return self.fill(f"{first} {held()}{more}{last if last[:1] in '.;:' else ' ' + last if last else ''}".strip())

    def bullet(self) -> list:
        if self.r.random() < 0.4:
            return self.mixed()
        return self.fill(self.r.choice(PLAIN if self.r.random() < 0.6 else PROSE))

    def resume(self):
        r = self.r
        head = r.choice(("", "", "", "", "CV of ", "Name: ", "Curriculum vitae — ", "Résumé: ", r.choice(("Ms ", "Mr ", "Dr. "))))
        self.add(head, self.name(self.given, self.last), "\n")
        bits: list[list] = []
        if r.random() < 0.85:
            bits.append([r.choice(("", "e: ", "Email: ", "")), self.email()])
        if r.random() < 0.8:
            bits.append([r.choice(("", "M: ", "Tel ", "Phone: ", "")), self.phone()])
        bits.append([self.address()] if r.random() < 0.3 else [f"{self.place()}, {self.state()}"])
        handle = r.choice("amber quiet slow north velvet green".split()) + r.choice("kite loom fern gull reed".split()) + str(r.randrange(10, 99))
        own = [self.given.lower(), self.last.lower().replace(" ", "")]
        bits += [[f"{site}/{r.choice((handle, handle, '-'.join(own)))}"] for site in ("linkedin.com/in", "linkedin.test/in", "github.com", "gitlab.test") if r.random() < 0.3]
        if r.random() < 0.3:
            r.shuffle(bits)
        sep = r.choice((" | ", " • ", " / ", "  ", "\n", " - "))
        for i, b in enumerate(bits):
            self.add(*([sep] if i else []), *b)
        self.add("\n")
        if r.random() < 0.5:
            self.add("\n", r.choice(("SUMMARY", "PROFILE")), "\n", *self.fill(r.choice(PLAIN)), ". ", *self.fill(r.choice(PLAIN)), ".\n")
        self.add("\n", r.choice(("EXPERIENCE", "WORK EXPERIENCE", "EMPLOYMENT")), "\n")
        mark = r.choice(("• ", "- ", "* ", "o ", "1) ", "▪ ", "(cid:127) "))
        for _ in range(r.randrange(1, 4)):
            y = r.randrange(2002, 2024)
            dates = r.choice((f"0{r.randrange(1, 9)}/{y} - 1{r.randrange(0, 3)}/{y + 1}", f"Jan {y} to Mar {y + 2}", f"Sep. {y} – present", f"Sep. {y} – present", ""))
            self.add(self.post(), ", ", self.company(), "    ", dates, "\n")
            for _ in range(r.randrange(1, 5)):
                self.add(mark, *self.bullet(), "\n")
            self.add("\n")
        if r.random() < 0.7:
            skills = r.sample([*TECH, "Bayesian methods", "German, fluent", "CI/CD", "prompt design", "Event Sourcing", "Kafka, self-hosted", "Public Speaking", "Risk Analysis", "TCP/IP"], r.randrange(1, 8))
            self.add("SKILLS\n", r.choice(("", "", "Tools: ", "Languages: ")), r.choice((", ", "; ", " | ", "\n", "\n• ", " / ", " • ", ",")).join(skills), "\n\n")
        if r.random() < 0.4:
            self.add("EDUCATION\n", f"{r.choice(('BSc', 'MSc', 'BA', 'Diploma'))} {r.choice(('Computing', 'Applied Mathematics', 'Physics', 'Modern History'))}, {self.place()} {r.choice(('Institute', 'University', 'College', 'Polytechnic'))}, {r.randrange(1995, 2022)}\n\n")
        if r.random() < 0.3:
            self.add(r.choice(("REFERENCES", "REFEREES")), "\n")
            for _ in range(r.randrange(1, 3)):
                self.reference()
        if r.random() < 0.25:
            self.add("PERSONAL\n")
            if r.random() < 0.7:
                self.add(*self.identity(), "\n")
            if r.random() < 0.6:
                self.add(r.choice(("Home: ", "Address: ", "Lives at ", "")), self.address(), "\n")

    def reference(self):
        r = self.r
        keep = self.given, self.last
        self.given, self.last = r.choice(GIVEN), self.surname()
        contact = [r.choice((", ", " - ", " — ", "; ")), self.email() if r.random() < 0.5 else self.phone()] if r.random() < 0.85 else []
        self.add(r.choice(("", "Ref: ", "Mr ", "Ms ", "Dr. ", "Prof. ", "Mrs ")), self.name(self.given, self.last, r.random() * 0.6), *contact, "\n")
        self.given, self.last = keep

    def line(self):
        """A quoted or single line."""
        r = self.r
        front, back = r.choice((("", ""), ("", ""), ("> ", ""), ("Line: ", ""), ("“", "”"), ("Quoted: ", ""), ('"', '"')))
        self.add(front)
        x = r.random()
        if x < 0.62:
            self.add(*self.bullet())
        elif x < 0.7:
            self.add(self.post(), ", ", self.company(), f"    0{r.randrange(1, 9)}/{r.randrange(2002, 2024)} - now")
        elif x < 0.78:
            self.add(self.name(self.given, self.last))
        elif x < 0.86:
            self.reference()
            self.text = self.text.rstrip("\n")
        elif x < 0.94:
            self.add(r.choice(("", "e: ", "Email: ")), self.email(), r.choice((" | ", " • ", " / ", "  ")), r.choice(("", "M: ", "Tel ")), self.phone(), " | ", f"{self.place()}, {self.state()}")
        else:
            self.add(*(self.identity() if r.random() < 0.5 else [r.choice(("Home: ", "Address: ", "")), self.address()]))
        self.add(back)

    def letter(self):
        """A few sentences, as a paragraph or line by line."""
        r = self.r
        for _ in range(r.randrange(2, 7)):
            self.add(*self.bullet(), r.choice((". ", "\n", ".\n")))
        if r.random() < 0.4:  # a signature
            self.add("\n", self.name(self.given, self.last, 0.1), "\n", r.choice((self.post() + "\n", self.company() + "\n", "")), self.phone() if r.random() < 0.6 else self.email(), "\n")

    def contact(self):
        r, x = self.r, self.r.random()
        if x < 0.12:
            self.add(self.name(self.given, self.last, 0.1), " <", self.email(), ">")
        elif x < 0.2:
            self.add(r.choice(("@" + r.choice("maple otter lantern".split()) + str(r.randrange(10, 99)), "as above", "on request", "none")))
        elif x < 0.3:
            self.add(self.email(), r.choice(("; ", " / ", " or ", ", ")), self.email())
        else:
            self.add(r.choice(("", "", "", "", "mailto:", "E-mail: ", "e: ", "<", " ")), self.email(), r.choice(("", "", " ", ";", " (home)", " (work)", ">")))


def sample_texts(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n labelled texts: curricula, single lines, letters and address fields with everyday names, numbers and near misses."""
    out = []
    for i in range(n):
        m = Maker(random.Random(f"{seed}:{i}"))
        k = i % 20
        (m.resume if k < 7 else m.line if k < 14 else m.letter if k < 18 else m.contact)()
        out.append((m.text, m.spans))
    return out

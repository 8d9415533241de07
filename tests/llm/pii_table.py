"""Sentences written by hand, apart from the rules that make the training table: spans are marked <kind:...>."""

TABLE = """
For bookings, phone Martha at <phone:020 7946 0958> between nine and five.
Our Paris office can be reached at <phone:01 42 68 53 00>.
You may fax the signed form to <phone:(212) 555-0147> by Friday.
Tel.: <phone:089 / 1234567>
Call the clinic: <phone:415-555-0132>, extension follows.
If nobody answers, dial <phone:0049 30 9018200> instead.
Mobile <phone:07700 900123>
Ring me on <phone:0161 496 0000> tomorrow.
The plumber's number: <phone:(0221) 4710123>
llamame al tel <phone:612 34 56 78> por favor
Contact Olga, phone <phone:1-800-555-0199>, for keys.
Telefon: <phone:030-8612345> (Praxis)
Reach the desk on <phone:303.555.0188> at night.
fax <phone:01.45.67.89.10>
Write to <email:claire [at] nordwind [dot] net> with questions.
my mail is <email:tom(at)gmx.de> in case you need it
Applications go to <email:jobs at widgets dot com> before March.
<email:s.meyer [at] uni-bonn.de> will reply within a week.
reach Paul, <email:paul (at) riverside (dot) org>, about the tickets
Please mail <email:jane dot doe at fabrikam dot com> today.
address: <email:helpdesk AT contoso DOT net>
ask <email:lena[at]studio[dot]info> for prints
send invoices to <email:billing at north dot co dot uk>
email <email:max.muster (at) posteo.de> or come by
She wrote from <email:kate(at)harbor(dot)com> again.
Blocked host <ip:203[.]0[.]113[.]7> after nine tries.
traffic from <ip:198(.)51(.)100(.)23> was dropped
server <ip:192[.]0[.]2[.]44> answered slowly
Paid with <card:4111_1111_1111_1111> at the till.
my card number <card:5500.0000.0000.0004> was declined
visa <card:4012/8888/8888/1881> expired
Booked by card <card:4000 0566 5566 5556>, name on request.
The isbn 978 3 16 148410 0 belongs to a novel.
We shipped order 030 1234567 on Monday.
The sum of 555 123 4567 units was reported.
Transfer it from account 123-456-7890 at once.
Close ticket 212.555.1234 when done.
Read pages 100-200-3000 of the manual.
We met at noon dot that is all.
Invoice 020 4412 8890 remains unpaid.
The serial number 415-555-9921 is printed inside.
Tracking 1-800-222-3344 shows no movement.
Lot 44 12 87 90 31 went for a song.
A total of 212 555 8800 units left the plant.
The patent 00 49 1234567 was refused.
Reference 0221/4711882 in all letters, please.
Item 303.555.7712 is out of stock.
Case 089-1234567 goes to court in May.
Part 612 34 56 99 fits the older engine.
They looked at me. Dot by dot the picture grew.
He arrived at nine dot she left at ten.
Stay at home dot wash your hands.
There were 1 234 567 890 people in 1804.
It ran from 10 to 20, then 30 to 40, on 12 days.
The score was 21-15 19-21 15-12 in the end.
Version 10.2.33 replaced 9.8.1 in June.
Born 12.03.1984, died 04.11.2019 in Graz.
Rooms 101 102 103 104 105 are on this floor.
Between 2004-05-12 and 2009-11-30 nothing happened.
Ratio 3:2, length 12.75 m, weight 1,204.50 kg.
See figure 3.2.1 and table 12 [note 4].
The password 8f3a99c01b2244de was changed.
Meet me at the dot on the map at four.
""".strip().split("\n")

#: Written after the training table was settled; nothing was changed for it.
FRESH = """
Mum's landline is <phone:01865 270000> these days.
Give the vet a ring at <phone:(503) 555-0176>.
Dentist: phone <phone:030 2093 1234>, closed on Mondays.
Your driver will call from <phone:06 12 34 56 78>.
texts to <phone:0170/5550123> only
Fax <phone:(030) 22771234> for the press office
The night porter answers on <phone:917.555.0143>.
Spain: telephone <phone:934 567 890>
Complaints: <email:office at brightwater dot com>
She signs as <email:r.klein [at] verlag [dot] de> these days
Please reply to <email:noor dot ali at summit dot org>.
photo credits: <email:marta(at)fotohaus.com>
reach the editor, <email:desk (at) dailypost (dot) co>, by noon
The scan came from <ip:198[.]51[.]100[.]77> overnight.
Charged to <card:4242_4242_4242_4242>, thank you.
visa card <card:4556.7375.8689.9855> on file
Order 415-555-2671 was returned by the customer.
The ISBN 978 0 306 40615 7 is out of print.
Account 030 9018 2000 was frozen.
About 212 555 9000 units remain in the depot.
See pages 200-300-4000 in volume nine.
Ticket 0170/5559999 has been merged.
We ate at eight dot dot dot and slept.
She laughed at Tom. Dot com shares fell.
On 03.04.2020 at 10.30 some 1.250.000 people watched.
Seats 11 12 13 14 15 16 are taken.
""".strip().split("\n")

"""Messages, links, mails and numbers on which every rule fires or is vetoed; queries add them to table rows.

They are this engine's own test texts: (label, text), label 1 for a scam.
"""

from __future__ import annotations

MESSAGES = (
    (1, "URGENT: account suspended, act now and confirm your password and card number"),
    (1, "You have won the lottery, claim your prize and send bank details"),
    (0, "We will never ask for your password or pin number"),
    (1, "Do not tell the bank, say it is a family gift and transfer today"),
    (1, "A fee of $1.99 is due to release your parcel on hold https://auspost-parcels.top/pay"),
    (0, "The fee of $250.00 was paid, thank you"),
    (1, "Australia Post: delivery failed, update your address at http://bit.ly/x1"),
    (0, "Your insurance claim was lodged, the claim number is 77"),
    (1, "Apartment for rent, deposit first, send your bank details and the keys by post will follow"),
    (1, "You are eligible for the government grant, open https://grants.click/apply"),
    (1, "Hi mum, this is my new number, I lost my phone and need to pay a bill"),
    (0, "Hi mum, this is my new number, see you on Sunday"),
    (1, "Our payment details have changed, use the new account number below"),
    (1, "Settlement funds: send the deposit to the new trust account, our account details have changed"),
    (0, "Settlement funds: our account details have not changed, call us before you transfer"),
    (1, "Reply Y and reopen the message to activate the link https://evri-help.xyz/a"),
    (1, "Scan the QR code to settle the unpaid toll"),
    (1, "You have 1 new voicemail, listen to your voice message here http://vm.icu/1"),
    (1, "Press Win+R, paste the command and hit enter to verify"),
    (1, "Open Terminal and paste this to fix the issue"),
    (1, "Unverified sender: this number is not protected by the sender register, reply now"),
    (1, "Work from home, daily pay, no experience, flexible hours, earn per day"),
    (1, "Complete tasks to unlock your earnings, deposit USDT to withdraw your commission"),
    (1, "Send me the verification code we just sent to your account"),
    (0, "Your verification code is 123456. Do not share the code with anyone"),
    (1, "Your WhatsApp account will be banned, register again to keep your chats"),
    (1, "Verify now to release your winnings, jackpot pending verification"),
    (1, "We recovered your lost funds, pay a release fee to receive them"),
    (1, "Join the trading group for guaranteed returns in bitcoin"),
    (1, "Australia Post notice, urgent, https://post-help.top/x"),
    (0, "Australia Post delivered your parcel, see https://auspost.com.au/track"),
    (1, "ATO: outstanding tax, legal proceedings start today http://ato-gov.click/pay"),
    (1, "myGov officer: add us on WhatsApp to finish your tax refund"),
    (1, "HMRC: outstanding tax, pay now"),
    (1, "Netflix: payment failed, update at https://netflix-billing.xyz"),
    (0, "I watched Netflix last night"),
    (1, "Your Norton subscription was renewed for $399.99. If you did not authorise this, call +1 (803) 555-0142 to cancel"),
    (0, "Your order was charged. If you did not authorise this, use the app, never call numbers in messages"),
    (1, "Please call us on +61 2 5550 1234 now"),
    (1, "Coinbase: a withdrawal was requested, call +1 (803) 555-0111"),
    (1, "Kindly do the needful and verfy your acount"),
    (1, "Quantum AI Trader pays out every hour"),
    (1, "Please re-register your identity with the portal"),
    (1, "Chinese embassy: overseas police hold an arrest warrant for you, stay on the line"),
    (1, "Do not wait, send your password and card number now"),
    (1, "Payment of $220.00 has been charged. If you did not authorise this, call 1300 655 505"),
    (1, "Please call us on 13 24 61 now"),
    (1, "Fee of £1.50 to release your parcel"),
    (0, "Your refund of $13.50 from 1300 Flowers was paid on 2026-03-04"),
    (0, "Dinner at seven? Bring the salad"),
    (0, "The meeting moved to 3 pm, same room as before"),
    (1, "Unpаid tоll nоtice, pay at onсe"),
    (0, "Ваша посылка в пути, спасибо за заказ и ожидание"),
    (0, "La réunion est déplacée à demain matin, merci de confirmer"),
)

URLS = (
    "https://paypal.com/login", "http://paypal-secure.xyz/verify", "https://bit.ly/abc", "http://192.168.10.20/pay", "https://ipfs.io/ipfs/bafybeigdyrzt5sfp7udm7hu76uh7y26nf3",
    "https://shop.web.app/a?redirect=https://evil.example", "https://xn--pypal-4ve.com/", "https://a-b-c-d.example.com/", "https://a.b.c.d.e.example.co.uk/x", "https://ato.refund-help.com.au/a",
    "https://auspost.com.au/track?utm_source=x&id=9", "https://www.auspost.com.au./", "not a link", "https:///nohost", "https://amazpn.com/gp", "https://netfilx.com/", "https://nnetflix.com/a",
    "https://id.example.org/oauth2/authorize?client_id=1", "https://accounts.google.com/o/oauth2/authorize?x=1", "https://foo.www.ck/", "https://www.ck/", "https://x.y.ck/a", "https://city.kawasaki.jp/", "https://a.b.kawasaki.jp/",
    "HTTPS://User:pw@Sub.Example.COM.:8443/a//b?fbclid=1&x=2#f", "https://example.github.io/", "https://ups-parcel.click/" + "a" * 200, "https://blog.blogspot.com/x", "https://facebook.com.evil.top/signin", "https://my.gov.au/", "https://p\u0430ypal.com/login", "https://m\u00fcnchen-bank.de/",
)

NUMBERS = (
    "000", "911", "123", "1111111", "+61 412 345 678", "0412 345 678", "1900 123 456", "1800 123 456", "1300 123 456", "13 12 34", "02 5550 1234", "+44 7700 900123", "+44 90 1234 5678", "+1 (876) 555-0101", "+1 (212) 555-0101",
    "+216 55 501 001", "+234 803 555 0101", "+20 100 555 0100", "61412345678", "+61 1", "+881 555 0101 22", "0550 123 456", "+353 85 555 0101", "abc", "", "+675 7555 0101", "+62 812 5550 101",
)

MAILS = (
    'From: "PayPal Service" <help@pay-help.top>\nReply-To: boss@other.example\nReturn-Path: <x@bulk.example>\nSubject: Invoice\nAuthentication-Results: mx; spf=fail; dkim=none;\n dmarc=fail\n\nDear customer, open the attached invoice. Your Norton subscription was renewed for $399.99, call to cancel the order.',
    'From: Anna <anna@example.com>\nReply-To: anna@example.com\nSubject: Lunch\nAuthentication-Results: mx; spf=pass; dkim=pass header.d=example.com; dmarc=pass\n\nHi Ben, lunch on Friday?',
    'From: "ATO Refunds" <refund@ato-refund.click>\nSubject: Tax refund\nAuthentication-Results: mx; spf=softfail; dmarc=none\nList-Unsubscribe: <mailto:u@x>\n\nDear taxpayer, your tax refund is ready, urgent: confirm your bank details http://ato-gov.click/a',
    'From: "ceo@corp.example" <ceo@gmail-mail.icu>\nSubject: Task\nAuthentication-Results: mx; spf=pass; dkim=pass header.d=mailer.example; dmarc=none\nContent-Language: ru\n\nAre you at your desk? Keep this secret.',
    'From: "Microsoft Account" <no-reply@ms-alerts.xyz>\nSubject: Sign in\nAuthentication-Results: mx; spf=pass; dkim=pass header.d=ms-alerts.xyz; dmarc=pass\nContent-Language: ru\n\nGo to microsoft.com/devicelogin and enter the code ABCD-EFGH. See attached document statement.svg to review.',
    'From: News <news@list.example.co.uk>\nReturn-Path: <bounce@mailer.example.co.uk>\nSubject: Weekly\nList-Id: <weekly.example>\n continued\nAuthentication-Results: mx; spf=pass; dkim=pass header.d=example.co.uk; dmarc=pass\n\nThis week in the garden.',
    'From: "Geek Squad and McAfee" <a@billing.rest>\nSubject: Renewal\n\nDear user, your Geek Squad and McAfee plan was renewed for $89.00. To dispute the charge call us.',
    'Subject: no sender\n\nPlain text without a sender, delivery failed, act now.',
)

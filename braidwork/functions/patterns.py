"""Pattern dictionaries: technologies, revenue models, calls to action, hiring, local credentials. Only tables."""

# Fixed values: (technology, category, pattern in a page's markup).
TECHNOLOGIES = [
    ("WordPress", "CMS", r"wp-content|wp-includes|/wp-json/"),
    ("Shopify", "E-commerce platform", r"cdn\.shopify\.com|shopify\.theme|myshopify\.com"),
    ("Squarespace", "Site builder", r"squarespace\.com|static1\.squarespace"),
    ("Wix", "Site builder", r"wix\.com|wixstatic\.com|X-Wix"),
    ("Webflow", "Site builder", r"webflow\.(com|io)|data-wf-page"),
    ("WooCommerce", "E-commerce platform", r"woocommerce"),
    ("BigCommerce", "E-commerce platform", r"bigcommerce\.com"),
    ("Magento", "E-commerce platform", r"magento|/static/version\d+/frontend"),
    ("Ghost", "CMS", r"ghost\.io|/ghost/api/"),
    ("Drupal", "CMS", r"drupal|/sites/default/files"),
    ("HubSpot CMS", "CMS", r"hs-sites\.com|hubspot\.net/hub"),
    ("Next.js", "Framework", r"/_next/static|__NEXT_DATA__"),
    ("Nuxt", "Framework", r"/_nuxt/|__NUXT__"),
    ("React", "Framework", r"react(-dom)?[.@][\d.]|data-reactroot"),
    ("Vue", "Framework", r"vue[.@][\d.]|data-v-[0-9a-f]{8}"),
    ("Angular", "Framework", r"ng-version|angular[.@][\d.]"),
    ("Svelte", "Framework", r"svelte-[0-9a-z]{6}|/_app/immutable/"),
    ("Gatsby", "Framework", r"___gatsby|gatsby-"),
    ("Astro", "Framework", r"astro-island|data-astro-"),
    ("Google Analytics", "Analytics", r"googletagmanager\.com/gtag|google-analytics\.com|gtag\("),
    ("Google Tag Manager", "Analytics", r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]{4,}"),
    ("Plausible", "Analytics", r"plausible\.io/js"),
    ("Fathom", "Analytics", r"usefathom\.com"),
    ("Mixpanel", "Analytics", r"mixpanel"),
    ("Amplitude", "Analytics", r"amplitude\.com/libs|amplitude\.getInstance"),
    ("Segment", "Analytics", r"cdn\.segment\.(com|io)|analytics\.load\("),
    ("Hotjar", "Analytics", r"hotjar\.com|hjSiteSettings"),
    ("PostHog", "Analytics", r"posthog\.(com|js)"),
    ("HubSpot", "Marketing / CRM", r"js\.hs-scripts\.com|hubspot\.com/analytics"),
    ("Marketo", "Marketing / CRM", r"marketo\.(net|com)"),
    ("Mailchimp", "Marketing / CRM", r"mailchimp\.com|list-manage\.com"),
    ("Klaviyo", "Marketing / CRM", r"klaviyo\.com"),
    ("Salesforce", "Marketing / CRM", r"salesforce\.com|force\.com"),
    ("Facebook Pixel", "Advertising", r"connect\.facebook\.net.*fbevents|fbq\("),
    ("Google Ads", "Advertising", r"googleadservices\.com|/pagead/conversion"),
    ("LinkedIn Insight", "Advertising", r"snap\.licdn\.com"),
    ("Stripe", "Payments", r"js\.stripe\.com|checkout\.stripe\.com"),
    ("PayPal", "Payments", r"paypal(objects)?\.com"),
    ("Paddle", "Payments", r"paddle\.com|paddle_button"),
    ("Chargebee", "Payments", r"chargebee\.com"),
    ("Recurly", "Payments", r"recurly\.(com|js)"),
    ("Square", "Payments", r"squareup\.com|squarecdn\.com"),
    ("Intercom", "Support", r"intercom(cdn|\.io|settings)"),
    ("Zendesk", "Support", r"zendesk\.com|zdassets\.com"),
    ("Crisp", "Support", r"crisp\.chat"),
    ("Drift", "Support", r"js\.driftt\.com|drift\.com"),
    ("Front", "Support", r"frontapp\.com"),
    ("Help Scout", "Support", r"helpscout\.(net|com)|beacon-v2"),
    ("Auth0", "Auth", r"auth0\.com"),
    ("Okta", "Auth", r"okta(cdn)?\.com"),
    ("Firebase", "Backend", r"firebaseio\.com|firebaseapp\.com"),
    ("Algolia", "Search", r"algolia(net)?\.(com|net)"),
    ("Sentry", "Monitoring", r"sentry(-cdn)?\.(io|com)|browser\.sentry"),
    ("Cloudinary", "Media", r"cloudinary\.com"),
    ("Typeform", "Forms", r"typeform\.com"),
    ("Calendly", "Scheduling", r"calendly\.com"),
]
# Fixed values: (technology, category, response header, pattern in its value).
HEADERS = [
    ("Cloudflare", "Hosting / CDN", "server", r"cloudflare"),
    ("Vercel", "Hosting / CDN", "server", r"vercel"),
    ("Netlify", "Hosting / CDN", "server", r"netlify"),
    ("Fastly", "Hosting / CDN", "x-served-by", r"cache-"),
    ("AWS CloudFront", "Hosting / CDN", "via", r"cloudfront"),
    ("AWS S3", "Hosting / CDN", "server", r"amazons3"),
    ("Nginx", "Web server", "server", r"nginx"),
    ("Apache", "Web server", "server", r"apache"),
    ("Shopify", "E-commerce platform", "powered-by", r"shopify"),
    ("WP Engine", "Hosting / CDN", "x-powered-by", r"wp engine"),
    ("Google Cloud", "Hosting / CDN", "server", r"gse|google frontend"),
]
# Platforms that a site depends on.
DEPENDENCIES = ["Shopify", "WordPress", "Squarespace", "Wix", "Webflow", "WooCommerce", "BigCommerce", "Magento", "HubSpot CMS", "Ghost"]
# Fixed value: products that a site says it integrates with.
INTEGRATION = r"(?i)\bintegrat(es|ion|ions)\s+with\s+([A-Z][\w.+-]*(?:,?\s+(?:and\s+)?[A-Z][\w.+-]*){0,6})"

# Revenue models, each with (pattern, weight).
MODELS = {
    "saas": [
        (r"\bper\s+(user|seat|month|editor|agent)\b", 3.0),
        (r"\b(subscription|subscribe now|billed (monthly|annually|yearly))\b", 2.5),
        (r"\bfree trial\b", 2.0),
        (r"\b(start(ing)? free|sign up free|get started free)\b", 1.5),
        (r"\b(dashboard|integrations?|api key|workspace|single sign-on|sso)\b", 1.0),
        (r"\b(cancel any\s?time|no credit card required)\b", 1.5),
        (r"/mo\b|/month\b|/year\b|\bmo\.\b", 2.0),
    ],
    "ecommerce": [
        (r"\badd to (cart|bag|basket)\b", 4.0),
        (r"\b(free shipping|shipping (rates|policy)|delivery times?)\b", 2.5),
        (r"\b(returns? policy|refund policy|exchanges?)\b", 1.5),
        (r"\b(in stock|out of stock|sold out|sizes?\b.*\bcolou?rs?)\b", 2.0),
        (r"\b(shop (now|all)|our (store|shop)|browse products)\b", 2.0),
        (r"\b(checkout|your (cart|bag))\b", 2.0),
    ],
    "services": [
        (r"\b(our clients|work with us|book a (call|consultation)|free consultation)\b", 3.0),
        (r"\b(consultancy|consulting|advisory|bespoke|tailored to your)\b", 2.5),
        (r"\b(case stud(y|ies)|our (process|approach)|engagements?)\b", 1.5),
        (r"\b(hourly rate|per project|statement of work|retainer)\b", 3.0),
        (r"\b(we (design|build|help|deliver)|our team (will|can))\b", 1.0),
        (r"\b(request a (quote|proposal)|get a quote)\b", 2.0),
    ],
    "local_services": [
        (r"\b(free (estimate|quote|inspection)|no obligation (quote|estimate))\b", 4.0),
        (r"\b(licen[cs]ed (and|&) insured|fully insured|bonded (and|&) insured)\b", 4.0),
        (r"\b(call (now|us|today)|give us a call|call for a)\b", 2.5),
        (r"\b(schedule (an |your )?(appointment|service|visit|consultation)|book (online|now|a visit))\b", 3.0),
        (r"\b(serving\s+(?-i:[A-Z])[\w.\- ]{2,40}(county|area|and surrounding|since)?|service area|areas we serve)\b", 3.0),
        (r"\b(residential (and|&) commercial|commercial (and|&) residential)\b", 3.0),
        (r"\b(emergency (service|repair|call)|24/7|same[- ]day service)\b", 2.5),
        (r"\b(family[- ]owned|locally owned|third[- ]generation|second[- ]generation)\b", 2.5),
        (r"\b(installation|repair|maintenance|cleanup|inspection)s?\b", 1.0),
        (r"\b(satisfaction guaranteed|free consultation|senior discount|financing available)\b", 1.5),
    ],
    "marketplace": [
        (r"\b(buyers? and sellers?|sellers?|vendors?|merchants?)\b", 2.0),
        (r"\b(list(ing)?s? (on|your)|become a (seller|host|partner|provider))\b", 3.0),
        (r"\b(commission|take rate|transaction fee)\b", 2.5),
        (r"\b(browse (listings|providers)|find a (pro|provider|supplier))\b", 2.0),
    ],
    "media": [
        (r"\b(advertise with us|sponsorships?|media kit|ad rates)\b", 3.5),
        (r"\b(newsletter|subscribers|our readers|editorial)\b", 1.5),
        (r"\b(paywall|members? only|become a (member|supporter)|patron)\b", 2.5),
    ],
    "hardware": [
        (r"\b(specifications?|dimensions|warranty|ships? within)\b", 2.0),
        (r"\b(device|hardware|unit|assembly|installation guide)\b", 1.5),
        (r"\b(distributors?|resellers?|wholesale)\b", 2.0),
    ],
}
# Platforms that tell of a model, with their weights; a site's own contact facts, with theirs.
SHOP_PLATFORMS, SHOP_WEIGHT = ["shopify", "woocommerce", "bigcommerce", "magento", "squarespace commerce"], 8.0
BILLING_PLATFORMS, BILLING_WEIGHT = ["stripe", "paddle", "chargebee", "recurly"], 2.5
LOCAL_FACTS = [
    ("service_areas", "a published service area", 3.0), ("phone_in_header", "a phone number in the site header", 2.5),
    ("opening_hours", "published opening hours", 2.0), ("addresses", "a published street address", 1.5),
]
MODEL_SCORE, MODEL_HITS, CLOSE_SECOND = 5.0, 3, 0.75
# Calls to action.
SELF_SERVE = r"(?i)\b(sign ?up|get started|buy now|add to (cart|bag|basket)|create (an )?account|start (your |a |the )?(\d{1,3}[- ]day )?(free )?(trial|plan)|try (it |us )?(for )?free|free trial|start free|no credit card required)\b"
SALES_LED = r"(?i)\b(contact sales|talk to (sales|us)|book a (demo|call)|request a (demo|quote|proposal)|get in touch|schedule a (demo|call)|custom pricing|enterprise pricing|get a (quote|estimate)|free estimate|request service|schedule (an |your )?(appointment|service|visit)|call (now|today|us))\b"
# Prices, billing periods, free tiers.
AMOUNT = r"\d{1,3}(?:[.,\s]\d{3})*(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
SYMBOL = r"[$£€¥]|USD|EUR|GBP|CAD|AUD|CHF|SEK|NOK|DKK|PLN"
CODES = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY"}
PERIOD = r"(?i)\bper\s+(month|year|user|seat|month,? billed \w+|annum)\b|/\s?(mo|month|yr|year|user|seat)\b"
FREE_TIER = r"(?i)\b(free (plan|tier|forever|for ever)|\$0\s?(/|per)|free for (individuals|personal|up to)|always free|no cost)\b"
TRIAL = r"(?i)\b(\d{1,3})[- ]day (free )?trial\b"
# Hiring.
JOB_HOSTS = r"(?i)(greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com|breezy\.hr|bamboohr\.com|recruitee\.com|teamtailor\.com|smartrecruiters\.com|jobvite\.com|workday(jobs)?\.com|personio\.de|join\.com|rippling\.com)"
JOB_PATH = r"(?i)/(jobs?|careers?|positions?|openings?|vacanc)"
NO_OPENINGS = r"(?i)\b(no (current(ly)? )?(open (roles|positions|jobs)|openings|vacancies)|we(?:'| a)?re not (currently )?hiring|check back|no positions available)\b"
APPLY_LINE = r"(?i)^(apply now|apply|view (job|role|position)|see (job|role))$"
JOB_INDEX = r"(?i)^\s*(careers?|jobs?|open (jobs?|roles?|positions?)|openings?|vacancies|work (with us|here)|join (us|the team)|all (jobs?|roles?|openings?)|current (openings?|vacancies)|life at \w+|browse (jobs?|roles?))\s*$"
DEPARTMENTS = {
    "Engineering": ["engineer", "developer", "sre", "devops", "backend", "frontend", "full stack", "platform"],
    "Product": ["product manager", "product owner", "product lead"],
    "Design": ["designer", "ux", "ui ", "creative"],
    "Sales": ["sales", "account executive", "business development", "revenue"],
    "Marketing": ["marketing", "growth", "content", "seo", "brand"],
    "Customer Success": ["customer success", "support", "account manager", "onboarding"],
    "Operations": ["operations", "logistics", "supply", "office manager"],
    "Finance / Legal": ["finance", "accountant", "controller", "legal", "counsel"],
    "People": ["recruiter", "people ops", "hr ", "talent"],
}
# Credentials of local businesses, and when they are open.
CREDENTIALS = [
    ("Licensed & insured", r"\blicen[cs]ed\s*(?:and|&)\s*insured\b"), ("Bonded & insured", r"\bbonded\s*(?:and|&)\s*insured\b"), ("Fully insured", r"\bfully insured\b"),
    ("State licence number published", r"\b(?:lic(?:ense|ence)?\.?\s*(?:no\.?|#|number)\s*[:.]?\s*[A-Z]{0,3}[- ]?\d{4,})"),
    ("BBB accredited", r"\bbbb\s*(?:accredited|a\+|rating)\b"), ("EPA certified", r"\bepa\s*(?:certified|certification)\b"), ("NATE certified", r"\bnate[- ]certified\b"), ("Certified arborist", r"\bcertified arborists?\b"),
]
ALWAYS_OPEN = r"(?i)\b(24[/ ]?7|24 hours a day|open 24 hours|around the clock)\b"
# Links that are a network's own, telephone numbers, street addresses, states, service areas, opening hours.
GENERIC_SOCIAL = r"(?i)/(sponsors|explore|about|home|login|signup|share|intent|hashtag|search|pricing|features|topics|trending|watch|results|policies|legal|help)(/|$)"
TEL_LINK = r"(?i)tel:\+?[\d\s().\-]{6,}"
PHONE_TEXT = r"(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?|\d{2,4}[\s.\-])\d{3,4}[\s.\-]?\d{3,4}\b"
US_ADDRESS = r"(?i)\d{1,6}\s+[\w.'\-]+(?:\s+[\w.'\-]+){0,4}\s+(street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|suite|ste|floor|fl)\b[^\n]{0,60}"
SERVICE_AREA = r"\b(?i:proudly serving|serving the|serving|service areas?|areas we serve|we serve|areas served)\b\s*:?\s*([A-Z][\w.'\-]*(?:[ ,&/]+(?:and\s+)?[A-Z][\w.'\-]*){0,8})"
HOURS = r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?\s*[-–—to]{1,3}\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?[^\n]{0,30}?\d{1,2}(?::\d{2})?\s*(?:am|pm)[^\n]{0,20}"
TRAILING_STATE = r"\b([A-Z]{2})\b(?:\s+\d{5}(?:-\d{4})?)?\s*$"
# Claims of age, of money raised, and of how many people work there.
FOUNDED = r"(?i)\b(?:founded|established|est\.?|started|launched|since|serving\s+\w+\s+since)\s*(?:in\s+)?(19\d{2}|20[0-2]\d)\b"
FUNDING = (
    r"(?i)\b(?:raised|raising|closed|secured)\s+(?:a\s+|an\s+)?(?:\$|€|£)?[\d.]+\s*(?:million|billion|m\b|bn\b|k\b)?[^.\n]{0,40}|\bseries\s+[a-e]\b(?:\s+round)?|\b(?:seed|pre-seed)\s+(?:round|funding|investment)\b"
    r"|\bbacked by\s+[A-Z][^.\n]{0,50}|\b(?:acquired by|acquisition by|merged with)\s+[A-Z][^.\n]{0,50}|\b(?:y ?combinator|techstars)\b(?:\s+\(?[WS]\d{2}\)?)?"
)
COUNT = r"(?<![\d,.])(\d{1,3}(?:,\d{3})+|\d{1,5})(?!\d|,\d)"
APPROX = r"(?:about\s+|around\s+|over\s+|more than\s+|nearly\s+)?"
NOT_PEOPLE = (
    r"restaurants?|brands?|companies|businesses|stores?|shops?|locations?|products?|offices?|sites?|websites?|hotels?|clinics?|practices?|publications?|titles?|apps?|services?|communities|blogs?|newsletters?|"
    r"podcasts?|projects?|labels?|studios?|franchises?|dealerships?|branches?|outlets?|brands|properties|vehicles?|trucks?|stores"
)
PERSON_NOUN = r"employees|people|staff|team members|professionals|engineers|designers|developers|consultants|technicians|specialists|advisors|advisers|experts|contractors|craftspeople|colleagues"
HEADCOUNT = (
    rf"(?i)\b(?:team of|we(?:'| a)?re a? ?team of|staff of|group of|family of|company of)\s+{APPROX}{COUNT}\b(?!\s+(?:{NOT_PEOPLE})\b)"
    rf"|\b(?:we (?:have|employ)|employing|with a team of|our team of)\s+{APPROX}{COUNT}\+?\s+(?:{PERSON_NOUN})\b"
)

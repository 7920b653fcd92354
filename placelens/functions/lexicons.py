"""Word lists, lookup tables and constants the results depend on."""

# Aspect keywords, matched as substrings of the lowered text.
ASPECT_KEYWORDS = {
    "food": "taste fresh portion delicious flavor food meal dish cooked menu appetizer dessert sushi pizza burger".split(),
    "service": "service staff waiter waitress server host manager rude friendly slow fast attentive".split(),
    "atmosphere": "atmosphere ambiance ambience cozy noisy noise decor music lighting romantic loud quiet vibe".split(),
    "value": "price cheap expensive worth value money deal overpriced affordable bill".split(),
}

# Sentiment words, matched as whole tokens.
POSITIVE_WORDS = """great excellent amazing love loved best fantastic wonderful delicious perfect
good nice tasty fresh friendly attentive cozy worth affordable""".split()
NEGATIVE_WORDS = """bad terrible awful worst disgusting rude slow dirty overpriced bland cold
gross disappointing poor horrible nasty inedible stale burnt soggy""".split()
HARSH_WORDS = """bad rude dirty slow terrible awful disgusting worst gross horrible nasty
inedible stale burnt soggy cold bland overpriced rudest filthy""".split()

# Complaint phrases, matched as substrings of the lowered text.
COMPLAINT_PHRASES = [
    "never again", "waste of money", "food poisoning", "hair in", "cockroach", "roach", "dispute", "refund",
    "walked out", "health code", "filthy", "unacceptable", "rip off", "scam", "complaint", "horrible service",
    "worst experience", "disgusting", "got sick", "rude", "dirty",
]

# Stop words of the theme extraction.
THEME_STOPWORDS = """a an the and or but if then so to of for in on at by with from about into over under near
around close within just very really like is it its was were be been being are i we you they them our your my me
this that these those food restaurant restaurants""".split()

# Stop words of the search-query terms.
QUERY_STOPWORDS = """a an the and or but if then so to of for in on at by with from near around close within
inexpensive affordable cheap moderate moderately reasonable midrange mid-range expensive fancy upscale fine dining
splurge budget low cost km kilometer kilometers miles mi restaurant restaurants place want need looking best
food""".split()

# Default stop words of the text index; pass another list where the corpus needs one.
INDEX_STOPWORDS = """a about above after again against all also am an and any are as at be because been before
being below between both but by can could did do does doing down during each few for from further had has have
having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on
once only or other our out over own same she should so some such than that the their them then there these they
this those through to too under until up very was we were what when where which while who whom why will with you
your""".split()

# Review weights for the nine half-star bins from 1.0 to 5.0.
HALF_STAR_WEIGHTS = [3.2, 3.2, 1.9, 1.9, 1.0, 1.0, 1.0, 1.9, 3.2]

# Cuisine needles of the query text in order of precedence.
CUISINE_NEEDLES = [
    "sushi", "japanese", "steakhouse", "steak", "korean", "chinese", "italian", "mexican", "thai", "indian",
    "burger", "pizza", "fast food", "vegan", "vegetarian", "healthy", "salad",
]
# Cuisine found in the text to the label of the cuisine filter.
CUISINE_LABELS = {
    "sushi": "Sushi", "japanese": "Sushi", "steakhouse": "Steakhouse", "steak": "Steakhouse", "korean": "Korean",
    "chinese": "Chinese", "fast food": "Fast Food", "burger": "Burger", "healthy": "Healthy", "salad": "Healthy",
    "vegan": "Healthy", "vegetarian": "Healthy",
}
# Cuisine filter label to the category keywords it accepts.
CUISINE_KEYWORDS = {
    "Sushi": ["sushi", "japanese"],
    "Steakhouse": ["steak", "steakhouse"],
    "Korean": ["korean"],
    "Fast Food": ["fast food", "burger", "fries", "takeout"],
    "Chinese": ["chinese", "cantonese", "sichuan", "mandarin", "hunan", "taiwanese", "dim sum", "noodles", "mongolian"],
    "Burger": ["burger", "hamburgers", "burgers"],
    "Healthy": ["salad", "healthy", "vegan", "vegetarian"],
}

# Budget patterns in order of precedence.
BUDGET_PATTERNS = [
    ("cheap", r"\b(cheap|affordable|budget|inexpensive|low[- ]?cost)\b"),
    ("expensive", r"\b(expensive|fancy|upscale|fine dining|splurge)\b"),
    ("moderate", r"\b(moderate|mid[- ]?range|midrange|reasonable)\b"),
]
# Words dropped from the end of a location phrase.
BUDGET_TAIL_WORDS = """cheap affordable budget inexpensive low cost expensive fancy upscale fine dining splurge
moderate midrange mid-range reasonable""".split()

KM_PER_MILE = 1.60934

# Landmarks in order of precedence: name, latitude, longitude.
LANDMARKS = [
    ("nyu", 40.7295, -73.9965),
    ("new york university", 40.7295, -73.9965),
    ("times square", 40.7580, -73.9855),
    ("philadelphia", 39.9526, -75.1652),
    ("philly", 39.9526, -75.1652),
    ("center city philadelphia", 39.9526, -75.1652),
    ("las vegas strip", 36.1147, -115.1728),
    ("nashville", 36.1627, -86.7816),
    ("tampa", 27.9506, -82.4572),
]

# Intent patterns in order of precedence; anything else is the default intent.
INTENT_PATTERNS = [
    ("intent_quick", r"\bfast\b|\bquick\b|\bcheap\b|\bgrab[\s-]?and[\s-]?go\b"),
    ("intent_romantic", r"\bdate\b|\bromantic\b|\bcozy\b|\banniversary\b"),
]
INTENTS = ["intent_quick", "intent_romantic", "intent_default"]
ARMS = ["explorer", "reputation", "convenience"]
ALPHA = 0.15
UCB_C = 0.5
# Five score weights per arm: semantic, rating, price, distance, popularity.
ARM_WEIGHTS = {
    "explorer": (1.35, 0.65, 0.15, 0.15, 0.2),
    "reputation": (0.75, 1.45, 0.15, 0.1, 0.3),
    "convenience": (0.7, 0.85, 0.2, 1.45, 0.15),
}
WEIGHT_NAMES = ["w_semantic", "w_rating", "w_price", "w_distance", "w_popularity"]
MANUAL_WEIGHTS = (0.85, 1.05, 0.15, 0.2, 0.1)
ACTION_REWARDS = {"detail_open": 1.0, "like": 1.0, "pass": -0.5, "refresh": -0.1, "slider_override": -0.1}

# Cities of the search index: lowered city, upper state.
INDEX_CITIES = [
    ("philadelphia", "PA"), ("tampa", "FL"), ("indianapolis", "IN"), ("tucson", "AZ"), ("nashville", "TN"),
    ("new orleans", "LA"), ("edmonton", "AB"), ("saint louis", "MO"), ("st. louis", "MO"), ("reno", "NV"),
    ("santa barbara", "CA"), ("boise", "ID"),
]

# State names and codes.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI",
    "wyoming": "WY", "district of columbia": "DC",
}

# Attributes one-hot encoded, and attributes always read as yes/no.
DUMMY_ATTRIBUTES = [
    "attr_wifi", "attr_alcohol", "attr_restaurantsattire", "attr_noiselevel", "attr_smoking", "attr_byobcorkage",
    "attr_agesallowed",
]
BINARY_ATTRIBUTES = [
    "attr_restaurantsdelivery", "attr_outdoorseating", "attr_businessacceptscreditcards", "attr_bikeparking",
    "attr_restaurantstakeout", "attr_caters", "attr_restaurantsreservations", "attr_restaurantsgoodforgroups",
    "attr_hastv", "attr_goodforkids", "attr_dogsallowed", "attr_wheelchairaccessible", "attr_drivethru",
    "attr_corkage",
]
# Model column name to the attribute it is read from.
BOOLEAN_FEATURES = {
    "attr_good_for_kids": "GoodForKids",
    "attr_takeout": "RestaurantsTakeOut",
    "attr_delivery": "RestaurantsDelivery",
    "attr_outdoor_seating": "OutdoorSeating",
    "attr_credit_card": "BusinessAcceptsCreditCards",
    "attr_reservations": "RestaurantsReservations",
    "attr_good_for_groups": "RestaurantsGoodForGroups",
}

# Photo URL pattern and the pictures shown where a place has no photo.
PHOTO_URL = "https://s3-media0.fl.yelpcdn.com/bphoto/%s/348s.jpg"
FALLBACK_PHOTOS = [
    "https://images.unsplash.com/photo-1517248135467-4c7edcad34c4?w=320&h=200&fit=crop&q=80",
    "https://images.unsplash.com/photo-1555396273-367ea4eb4db5?w=320&h=200&fit=crop&q=80",
    "https://images.unsplash.com/photo-1414235077428-338989a841e3?w=320&h=200&fit=crop&q=80",
    "https://images.unsplash.com/photo-1466978913421-dad2ebd01d17?w=320&h=200&fit=crop&q=80",
    "https://images.unsplash.com/photo-1552566626-52f8b828add9?w=320&h=200&fit=crop&q=80",
]

# Phrases of a category request and the category text they point to.
CATEGORY_ALIASES = [
    ("fast food", ["fast_food", "fast food"]),
    ("fastfood", ["fast_food", "fast food"]),
    ("fast-food", ["fast_food", "fast food"]),
    ("burger", ["burgers", "hamburger", "hamburgers", " burger"]),
    ("burgers", ["burgers", "hamburger", "hamburgers"]),
    ("coffee", ["coffee", "coffeeshops", "coffeeshop", "coffee_&_tea", " coffee"]),
    ("tea", ["tea", "bubble tea", "coffee_&_tea"]),
    ("pizza", ["pizza"]),
    ("sushi", ["sushi", "japanese", "japan"]),
    ("taco", ["mexican", "taco", "tex-mex", "mexic"]),
    ("dessert", ["desserts", "baker", "bakeries"]),
    ("bar", ["bars", "lounges", "pub", "sports bar"]),
    ("vegan", ["vegan", "vegetarian", "veggie"]),
]
# Categories suggested where nothing matches, in order.
CATEGORY_FALLBACKS = [
    "cat_american_(new)", "cat_french", "cat_steakhouses", "cat_wine_bars", "cat_cocktail_bars", "cat_seafood",
    "cat_italian", "cat_sushi_bars", "cat_tapas_bars", "cat_bars", "cat_restaurants",
]
# Former feature names and the columns that carry them now.
FEATURE_ALIASES = {
    "local_restaurant_count": "count_all_3.0km",
    "local_same_category_count": "count_same_cat_3.0km",
    "local_same_category_ratio": "same_cat_ratio_3.0km",
    "distance_to_nearest_same_category": "dist_nearest_same_cat",
    "local_same_category_avg_rating": "avg_rating_same_cat_3.0km",
    "local_same_category_survival_rate": "survival_same_cat_3.0km",
    "local_category_diversity": "diversity_3.0km",
}

"""Fixed values that decide results: word lists, keyword tables, breakpoints and labels, as they have to be."""

# Tokens in a padded lower-case title that mark it as low signal.
LOW_SIGNAL_TOKENS = [
    " nfl", " nba", " mlb", " nhl", " ncaa", "super bowl", "world cup", "champions league", "premier league", "la liga", "uefa", "europa league",
    "wrestlemania", "ufc ", " mma ", " atp ", " wta ", " pga ", "tour de france", " f1 ", "formula 1", "esports", "valorant",
    "league of legends", " dota", "fifa world", "raiders", "cowboys", "patriots", "yankees", "lakers", "warriors",
    "draft pick", "trade rumor", "trade rumour", " mvp ", " roster ", " hoops ", " basketball ", " football ", " baseball ", " hockey ",
    " quarterback", " coach ", " head coach", " linebacker", "women's hoops", "men's hoops",
    "kardashian", "taylor swift", "kanye", " drake ", "rihanna", "beyonce", "mrbeast", "mr beast", "tiktok", " kpop", "k-pop",
    "red carpet", "celebrity", "oscars", "grammys", "emmys", "golden globe", "met gala", "reality tv",
    "weekend reads", "weekly reads", "assorted links", "what we're reading", "things i ", "10 things", "links for ", "links of the day", "morning links",
    ", rip", " rip:", "obituary", "obit:", "hilarious", "goes viral", "shocking moment", " parody ", "pole-dancing", "pole dancing",
    " spotted ", " spotted with", " spotted at", " spotted pumping", "hollywood", "action star", "movie star", "tv star",
]

# Phrases of which two mark a paywall.
PAYWALL_PHRASES = [
    "subscribe to unlock", "subscribe to read", "try unlimited access", "create your account", "sign in to read", "already a subscriber",
    "complete digital access", "ft journalism", "ft edit", "ft alphaville", "annual subscription", "explore more offers",
    "explore our full range", "per month then", "cancel anytime", "register to read", "log in to view", "subscribe now to",
    "hand-picked by ft", "month free with",
]

# Hedging words.
HEDGING_WORDS = [
    "allegedly", "reportedly", "purportedly", "apparently", "seemingly", "may", "might", "could", "would", "should", "possibly", "perhaps",
    "claims", "suggests", "appears", "seems", "believed", "thought", "according", "sources", "officials", "experts", "analysts",
]

# Market categories by the first keyword that a question contains; the rest is finance.
CATEGORY_KEYWORDS = {
    "macro": ["fed ", "fomc", "rate cut", "rate hike", "interest rate", "cpi", "inflation", "recession", "gdp ", "unemployment", "jobs report", "treasury", "yield curve", "powell"],
    "geopolitics": ["russia", "ukraine", "putin", "zelensky", "ceasefire", "iran", "israel", "gaza", "hamas", "hezbollah", "china", "xi jinping", "taiwan", "north korea",
                    "nato", "war", "invasion", "missile", "nuclear", "saudi", "venezuela", "syria", "yemen", "houthi"],
    "politics": ["trump", "biden", "harris", "vance", "election", "supreme court", "scotus", "congress", "house ", "senate", "governor", "primary", "impeach", "pardon"],
    "crypto": ["bitcoin", "btc", "ethereum", "eth ", "crypto", "solana", "coinbase", "stablecoin", "tether"],
}

# Keywords that drop a market question.
SKIP_KEYWORDS = [
    "nfl", "nba", "mlb", "nhl", "ncaa", "super bowl", "world cup", "champions league", "uefa", "epl", "premier league", "la liga",
    "wrestlemania", "boxing", "ufc", "mma", "tennis ", "atp ", "wta ", "pga ", "masters tournament", "tour de france", "f1 ", "formula 1",
    "esports", "valorant", "league of legends", "dota", "oscar", "grammy", "emmy", "academy award", "golden globe",
    "drake", "kanye", "taylor swift", "kardashian", "rihanna", "tweets from", "tweet count", "tweets between", "post tweets",
    "mrbeast", "mr beast", "video get", "video views", "video have", "youtube views", "subscribers by",
    "instagram followers", "tiktok views", "follower count",
]

# Terms that tie a headline to a market.
CROSS_REFERENCE = [
    "iran", "russia", "ukraine", "putin", "zelensky", "china", "taiwan", "israel", "gaza", "hamas", "hezbollah", "north korea", "houthi",
    "fed", "powell", "rate", "cpi", "inflation", "recession", "bitcoin", "ethereum", "crypto", "tether",
    "trump", "biden", "harris", "musk", "election", "oil", "opec", "wti", "gold", "copper",
]

# News keywords of a market symbol; other symbols stand for themselves.
SYMBOL_KEYWORDS = {
    "^GSPC": ["S&P 500", "S&P500"], "^IXIC": ["Nasdaq"], "^DJI": ["Dow Jones", "Dow Industrials"], "^RUT": ["Russell 2000"],
    "^VIX": ["VIX", "volatility index"], "^VVIX": ["VVIX"], "^SKEW": ["SKEW"],
    "ES=F": ["S&P 500 futures", "S&P futures"], "NQ=F": ["Nasdaq futures"], "YM=F": ["Dow futures"], "RTY=F": ["Russell futures"],
    "CL=F": ["WTI", "crude oil", "WTI crude"], "BZ=F": ["Brent", "Brent crude"], "NG=F": ["natural gas", "natgas"], "RB=F": ["gasoline"],
    "GC=F": ["gold"], "SI=F": ["silver"], "HG=F": ["copper"], "PL=F": ["platinum"], "PA=F": ["palladium"],
    "ZC=F": ["corn"], "ZW=F": ["wheat"], "ZS=F": ["soybean", "soybeans"], "KC=F": ["coffee"], "SB=F": ["sugar"], "CT=F": ["cotton"],
    "ZN=F": ["10-year", "10 year treasury", "treasury yield"], "ZB=F": ["30-year treasury", "long bond"],
    "DX=F": ["dollar index", "DXY"], "BTC=F": ["bitcoin", "BTC"], "ETH=F": ["ethereum", "ether"],
    "AAPL": ["Apple", "iPhone"], "MSFT": ["Microsoft"], "NVDA": ["Nvidia"], "GOOGL": ["Google", "Alphabet"], "META": ["Meta", "Facebook"],
    "AMZN": ["Amazon"], "TSLA": ["Tesla", "Musk"], "AVGO": ["Broadcom"], "JPM": ["JPMorgan", "JP Morgan"], "BRK-B": ["Berkshire", "Buffett"],
    "COIN": ["Coinbase"], "PLTR": ["Palantir"], "AMD": ["AMD", "Advanced Micro Devices"],
    "SPY": ["S&P 500"], "QQQ": ["Nasdaq"], "GLD": ["gold"], "USO": ["oil"], "TLT": ["treasury", "bond market"], "HYG": ["high yield", "junk bond"],
}

# The market page's buckets, in order.
BUCKETS = {
    "indices": ["^GSPC", "^DJI", "^IXIC", "^RUT"],
    "volatility": ["^VIX", "^VVIX", "^SKEW"],
    "megacaps": ["AAPL", "MSFT", "NVDA", "GOOGL", "AMZN", "META", "TSLA", "BRK-B", "JPM", "AVGO", "AMD", "PLTR", "COIN"],
    "commodities": ["CL=F", "BZ=F", "NG=F", "RB=F", "GC=F", "SI=F", "HG=F", "PL=F", "PA=F", "ZC=F", "ZW=F", "ZS=F", "KC=F", "SB=F", "CT=F"],
    "futures": ["ES=F", "NQ=F", "YM=F", "RTY=F", "ZN=F", "ZB=F", "ZF=F", "DX=F", "6E=F", "6J=F", "BTC=F", "ETH=F"],
    "etfs": ["SPY", "QQQ", "DIA", "IWM", "TLT", "GLD", "USO", "UUP", "HYG", "XLK", "XLF", "XLE", "XLV", "SMH"],
}

# Chart ranges and the (range, interval) they ask for.
CHART_RANGES = {"1d": ("1d", "5m"), "5d": ("5d", "15m"), "1mo": ("1mo", "1d"), "6mo": ("6mo", "1d"), "1y": ("1y", "1d"), "5y": ("5y", "1wk")}

# Sources with a prestige bonus, and those of the default feed.
PRESTIGE_SOURCES = ["foreign_affairs", "foreign_policy", "war_on_rocks", "nature", "science_mag"]
ESSENTIAL_SOURCES = ["marginal_revolution", "ritholtz", "liberty_street", "econbrowser", "foreign_affairs", "foreign_policy", "war_on_rocks", "nature", "science_mag", "quanta"]

# Outlet leanings, by side.
LEFT_LABELS, RIGHT_LABELS = ["far_left", "left", "lean_left"], ["lean_right", "right", "far_right"]

# Weather code labels.
WMO_LABELS = {
    0: "Clear", 1: "Mostly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Rime fog", 51: "Light drizzle", 53: "Drizzle", 55: "Heavy drizzle",
    56: "Freezing drizzle", 57: "Freezing drizzle", 61: "Light rain", 63: "Rain", 65: "Heavy rain", 66: "Freezing rain", 67: "Freezing rain",
    71: "Light snow", 73: "Snow", 75: "Heavy snow", 77: "Snow grains", 80: "Rain showers", 81: "Rain showers", 82: "Heavy showers",
    85: "Snow showers", 86: "Heavy snow showers", 95: "Thunderstorm", 96: "Thunderstorm + hail", 99: "Thunderstorm + hail",
}

# Upper edges of the index bands and of each pollutant's concentrations in them (µg/m³).
AQI_EDGES = [50, 100, 150, 200, 300, 500]
POLLUTANT_EDGES = {
    "pm2_5": [12, 35.4, 55.4, 150.4, 250.4, 500.4], "pm10": [54, 154, 254, 354, 424, 604], "o3": [106, 137, 167, 206, 392, 600],
    "no2": [100, 188, 677, 1220, 2348, 3853], "so2": [92, 197, 484, 797, 1582, 2107], "co": [5040, 10760, 14200, 17630, 34800, 57700],
}
POLLUTANT_LABELS = {"pm2_5": "PM2.5", "pm10": "PM10", "o3": "O₃", "no2": "NO₂", "so2": "SO₂", "co": "CO"}
BAND_LABELS = ["Good", "Moderate", "USG", "Unhealthy", "Very unhealthy", "Hazardous"]
AQI_LABELS = ["Good", "Moderate", "Unhealthy for sensitive", "Unhealthy", "Very unhealthy", "Hazardous"]

# The emotions of a breakdown, in order.
EMOTIONS = ["anger", "fear", "joy", "sadness", "disgust", "trust", "anticipation", "surprise"]

#: A small lexicon of our own for the derived tables' prose; a full one is a parameter (see newsloom.sources.lexicon).
SMALL_LEXICON = {
    "positive": ["great", "good", "hope", "win", "the"], "negative": ["terrible", "worthless", "pathetic", "disaster", "trash"],
    "anger": ["disgusting", "stupid"], "fear": ["terrible", "disaster"], "joy": ["great", "win"], "sadness": ["pathetic"],
    "disgust": ["disgusting", "trash"], "trust": ["from", "with"], "anticipation": ["to"], "surprise": ["was"], "loaded_language": ["worthless", "idiot", "stupid"],
}

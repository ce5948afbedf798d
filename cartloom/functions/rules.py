"""Rule tables the operators join to.

Every table here holds fixed values: names, thresholds, rates and texts that
must read exactly so for results to agree.  All have a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lower limit of the summed score, segment.
RFM_BANDS_LIB = [(13, "Champions"), (10, "Loyal_Customers"), (7, "Potential_Loyalists"), (5, "At_Risk")]
RFM_REST_LIB = "Lost_Customers"
RFM_BANDS_NB = [
    (13, "Champions"),
    (11, "Loyal Customers"),
    (9, "Potential Loyalists"),
    (7, "New Customers"),
    (5, "At Risk"),
]
RFM_REST_NB = "Lost Customers"

# Lower limit of the churn probability, risk category.
RISK_CATEGORIES = [(0.8, "Critical"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")]
RISK_REST = "Very Low"

# Edges and names of the three risk bands.
RISK_BAND_EDGES = [0.0, 0.3, 0.7, 1.0]
RISK_BANDS = ["low", "medium", "high"]

# Expected success of a retention action by risk.
SUCCESS_RATES = {"Critical": 0.15, "High": 0.25, "Medium": 0.35, "Low": 0.45, "Very Low": 0.60}

SEGMENT_ADVICE_SCHEMA = (
    "rfm_segment string, strategy string, actions array<string>, budget_priority string, expected_roi string"
)
# Fixed values.
SEGMENT_ADVICE = [
    ("Champions", "Programme VIP exclusif",
     ["Offres personnalisées", "Early access produits", "Support premium"], "High", "Very High"),
    ("Loyal_Customers", "Fidélisation et upselling",
     ["Cross-selling", "Programme fidélité", "Contenus exclusifs"], "High", "High"),
    ("Potential_Loyalists", "Conversion en clients fidèles",
     ["Onboarding séquentiel", "Offres incitatives", "Social proof"], "Medium", "Medium"),
    ("At_Risk", "Réactivation urgente",
     ["Win-back campaigns", "Offres spéciales", "Feedback survey"], "Medium", "Medium"),
    ("Lost_Customers", "Reconquête ciblée",
     ["Campagnes réactivation", "Deep discounts", "Nouveautés"], "Low", "Low"),
]

RETENTION_SCHEMA = (
    "rule string, retention_priority string, retention_channel string, retention_offer string, "
    "retention_budget string, retention_timeline string, retention_actions string, estimated_budget int"
)
# Fixed values.
RETENTION = [
    ("critical_high_value", "P0 - Immediate", "Personal call + Email", "Exclusive 30% discount + VIP benefits",
     "High ($100+)", "24-48h", "Personal outreach, Custom offer, Account manager contact", 100),
    ("critical", "P1 - Urgent", "Email + SMS", "25% discount + Free shipping",
     "Medium ($50)", "3-7 days", "Win-back email series, Limited time offer, Product recommendations", 50),
    ("high_champion", "P1 - Urgent", "Email + Phone", "VIP early access + 20% off",
     "High ($75)", "1 week", "VIP re-engagement, Loyalty program promotion, New arrivals preview", 75),
    ("high", "P2 - Important", "Email sequence", "20% discount on favorites",
     "Medium ($30)", "2 weeks", "Personalized recommendations, Browsing behavior triggers, Social proof", 30),
    ("medium", "P3 - Monitor", "Automated email", "15% off next purchase",
     "Low ($20)", "1 month", "Newsletter engagement, Product education, Community building", 20),
    ("low", "P4 - Maintain", "Regular marketing", "Standard promotions",
     "Standard ($10)", "Ongoing", "Regular newsletter, Seasonal campaigns, Cross-selling", 10),
]

CAMPAIGN_SCHEMA = (
    "campaign_segment string, campaign_priority int, recommended_budget_per_customer double, "
    "expected_response_rate double, start_week int, every_weeks int, duration_weeks int, "
    "campaign_type string, recommended_channels array<string>"
)
# Fixed values.
CAMPAIGNS = [
    ("VIP_AtRisk", 100, 50.0, 0.25, 1, 2, 8, "retention_urgent", ["personal_call", "email", "direct_mail"]),
    ("VIP_Whales", 95, 30.0, 0.35, 2, 4, 12, "loyalty_premium", ["email", "personal_call", "direct_mail"]),
    ("Champions_Active", 90, 15.0, 0.40, 3, 4, 10, "engagement_loyalty", ["email", "sms", "social_media"]),
    ("Winback_Urgent", 85, 20.0, 0.15, 1, 3, 6, "winback_aggressive", ["sms", "email", "display_ads"]),
    ("Growth_Potential", 80, 12.0, 0.20, 4, 3, 8, "upsell_cross_sell", ["email", "social_media", "google_ads"]),
    ("New_Development", 70, 8.0, 0.18, 5, 2, 6, "onboarding_nurture", ["email", "social_media", "google_ads"]),
    ("Reactivation_Soft", 60, 5.0, 0.12, 6, 5, 8, "reactivation_gentle", ["email", "display_ads"]),
    ("Maintenance_LowCost", 30, 2.0, 0.08, 8, 8, 4, "maintenance_basic", ["email"]),
]

CHANNEL_COST_SCHEMA = "channel string, cost double"
# Fixed values.
CHANNEL_COSTS = [
    ("email", 0.10), ("sms", 0.20), ("social_media", 2.0), ("google_ads", 5.0),
    ("display_ads", 3.0), ("personal_call", 25.0), ("direct_mail", 8.0),
]

TARGET_SCHEMA = (
    "target string, cost_per_customer int, conversion_rate double, start_week int, duration_weeks int, "
    "campaign_type string, priority string, key_action string, uplift double"
)
# Fixed values; the uplift is null where no growth scenario names the target.
TARGETS = [
    ("SUPER_WHALES", 200, 0.40, 1, 4, "Approche B2B premium", "ULTRA", "Approche B2B dédiée", 0.15),
    ("CHAMPIONS", 50, 0.25, 2, 3, "Programme VIP", "ABSOLUE", "Programme VIP exclusif", 0.05),
    ("HIGH_VALUE", 80, 0.20, 3, 2, "Fidélisation premium", "PREMIUM", "Fidélisation premium", None),
    ("POTENTIAL_LOYALISTS", 30, 0.15, 5, 6, "Nurturing séquentiel", "CONVERSION", "Séquences nurturing", 0.30),
    ("ONE_SHOT_PROBLEM", 15, 0.08, 8, 4, "Réactivation massive", "CRITIQUE", "Campagnes réactivation", 0.20),
]

MESSAGE_SCHEMA = "target string, subject string, call_to_action string, message_cost int, main_channel string, body string"
# Fixed values.
MESSAGES = [
    ("SUPER_WHALES", "Offre Exclusive VIP - Compte dédié activé", "Contactez votre Account Manager", 200,
     "Email + Appel téléphonique",
     "Account Manager dédié; livraisons express gratuites à vie; accès prioritaire nouveautés; cadeaux sur-mesure"),
    ("CHAMPIONS", "Club Champions - Vos privilèges vous attendent!", "Profiter de mes -30%", 50,
     "Email + SMS de rappel",
     "-20% permanent sur tout le catalogue; livraisons express gratuites; support prioritaire; événements privés"),
    ("HIGH_VALUE", "Collection Premium - Accès anticipé activé", "Découvrir la collection", 80,
     "Email premium + Retargeting",
     "Sélection premium exclusive; pièces limitées; paiement en 3x sans frais; emballage premium offert"),
    ("POTENTIAL_LOYALISTS", "On vous a préparé quelque chose...", "Utiliser mon code MERCI15", 30,
     "Email + SMS + Social Media",
     "Code -15% MERCI15; livraison offerte dès 50€; programme fidélité 1€ = 1 point; conseils par chat"),
    ("ONE_SHOT_PROBLEM", "On vous offre une 2ème chance!", "Revenir avec -25%", 15,
     "Email + Pub Facebook/Instagram",
     "-25% sur tout code RETOUR25; livraison offerte; paiement à réception; retours gratuits 30 jours"),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table as a one-partition DataFrame."""
    return spark.createDataFrame(rows, schema).coalesce(1)

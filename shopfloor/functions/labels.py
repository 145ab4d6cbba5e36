"""Labels that appear in the results."""

# business types
CONSIGNMENT = "위탁"
PURCHASE = "매입"
OTHER = "기타"
BUSINESS_TYPES = (CONSIGNMENT, PURCHASE, OTHER)

# source codes of the business types
MARGIN_CONSIGNMENT = "FEE"
MARGIN_PURCHASE = "WONGA"
SUPPLY_CONSIGNMENT = "입점(위탁)"
SUPPLY_PURCHASE = "공급(매입)"

# defaults for missing dimension values
UNMATCHED_BRAND = "(미매칭)"
UNKNOWN_BRAND = "(미상)"
UNCLASSIFIED = "미분류"
UNCLASSIFIED_STOCK = "(미분류)"
NO_OPTION = "(옵션없음)"
UNASSIGNED_CONCEPT = "미지정"
OTHER_PERSON = "기타"
UNKNOWN_MEMBER = "미상"

# report labels
TOTAL = "합계"
DOMESTIC = "내국인"
FOREIGN = "외국인"
STORE = "매장"
HUB = "허브"
GROWTH_INVALID = "X"
GROWTH_NEW = "신규"
GROWTH_NONE = "—"
AB_NONE = "-"
BEST_SELLER = "판매TOP"
RISING = "급등"
FALLING = "급락"
ALL = "전체"
DAY_LABELS = ("전일", "-2일", "-3일", "-4일")
WEEKDAY_LABELS = ("월", "화", "수", "목", "금", "토", "일")
PRESET_LABELS = ("오늘", "이번주", "지난주", "이번달", "지난달", "올해", "전년")

# locations outside the stores
HUB_PLANT1 = "허브1000"
HUB_PLANT2 = "허브1700"
HUB_FULFILMENT = "MFS"
HUBS = (HUB_FULFILMENT, HUB_PLANT1, HUB_PLANT2)

# order ledger codes
STATUS_COMPLETE = 50
CLAIM_REFUND = "REFUND"
TAX_REFUND_NONE = "NONE"
CUSTOMER_DAILY = "daily_total"
PRICE_CHANNEL = 1

# order of the age bands is a parameter of the report; the label left out of shares is fixed
SHARE_EXCLUDED = "기타"

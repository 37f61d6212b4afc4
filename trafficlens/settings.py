"""Defaults shared by all operators."""

# Limits, lifetimes and thresholds of the modelled service.
PER_MINUTE = 60
PER_DAY = 10_000
MINUTE_SECONDS = 60
DAY_SECONDS = 86_400
CACHE_TTL_SECONDS = 3600
SEMANTIC_THRESHOLD = 0.97
MAX_SYNC_INPUTS = 100
CHUNK_SIZES = {"openai": 512, "gemini": 32}
RETRIES_PER_PROVIDER = 2
RETRY_DELAY_SECONDS = 1
PAGE_DEFAULT = 50
PAGE_MAX = 500
KEY_TAG = "sk-gw-live-"
KEY_TAG_EXTRA = 6
EMBEDDING_DIM = 768
VECTOR_LISTS = 100

# Enum domains of the data model.
CACHE_LAYERS = ["none", "exact", "semantic"]
STATUSES = ["success", "error", "rate_limited"]
JOB_STATUSES = ["pending", "running", "succeeded", "failed"]
JOB_KINDS = ["batch_embeddings"]
ROLES = ["system", "user", "assistant"]
BATCH_PROVIDERS = ["openai", "gemini"]
REJECTED_PROVIDER = "ratelimit"

# US dollars per 1000 tokens (provider, model, prompt, completion).
PRICES = [
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai", "gpt-4o", 0.005, 0.015),
    ("openai", "gpt-3.5-turbo", 0.0005, 0.0015),
    ("openai", "text-embedding-3-small", 0.00002, 0.0),
    ("gemini", "gemini-1.5-flash", 0.000075, 0.0003),
    ("gemini", "gemini-1.5-pro", 0.00125, 0.005),
    ("gemini", "gemini-2.0-flash", 0.0001, 0.0004),
]

# Upper bounds in seconds of the duration histogram.
DURATION_BUCKETS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]

# Upstream exception name -> error class, per provider.
ERROR_CLASSES = [
    ("openai", "RateLimitError", "rate_limit"),
    ("openai", "APITimeoutError", "timeout"),
    ("openai", "APIConnectionError", "timeout"),
    ("openai", "AuthenticationError", "auth"),
    ("openai", "BadRequestError", "bad_request"),
    ("openai", "APIStatusError", "server"),
    ("openai", "PermissionDeniedError", "server"),
    ("openai", "NotFoundError", "server"),
    ("openai", "ConflictError", "server"),
    ("openai", "UnprocessableEntityError", "server"),
    ("openai", "InternalServerError", "server"),
    ("gemini", "ResourceExhausted", "rate_limit"),
    ("gemini", "DeadlineExceeded", "timeout"),
    ("gemini", "Unauthenticated", "auth"),
    ("gemini", "PermissionDenied", "auth"),
    ("gemini", "InvalidArgument", "bad_request"),
    ("gemini", "GoogleAPIError", "server"),
    ("gemini", "GoogleAPICallError", "server"),
    ("gemini", "RetryError", "server"),
    ("gemini", "ClientError", "server"),
    ("gemini", "BadRequest", "server"),
    ("gemini", "FailedPrecondition", "server"),
    ("gemini", "OutOfRange", "server"),
    ("gemini", "Unauthorized", "server"),
    ("gemini", "Forbidden", "server"),
    ("gemini", "NotFound", "server"),
    ("gemini", "Conflict", "server"),
    ("gemini", "AlreadyExists", "server"),
    ("gemini", "Aborted", "server"),
    ("gemini", "TooManyRequests", "server"),
    ("gemini", "Cancelled", "server"),
    ("gemini", "ServerError", "server"),
    ("gemini", "InternalServerError", "server"),
    ("gemini", "Unknown", "server"),
    ("gemini", "DataLoss", "server"),
    ("gemini", "MethodNotImplemented", "server"),
    ("gemini", "BadGateway", "server"),
    ("gemini", "ServiceUnavailable", "server"),
    ("gemini", "GatewayTimeout", "server"),
]
# The names under which the service itself logs the classes, whatever the provider.
LOGGED_ERRORS = [
    ("ProviderRateLimitError", "rate_limit"),
    ("ProviderTimeoutError", "timeout"),
    ("ProviderServerError", "server"),
    ("ProviderAuthError", "auth"),
    ("ProviderBadRequestError", "bad_request"),
    ("ProviderDisabledError", "disabled"),
]
RETRYABLE = ["rate_limit", "timeout", "server"]
FATAL = ["auth", "bad_request", "disabled"]

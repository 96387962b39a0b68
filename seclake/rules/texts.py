"""What each rule tells the reader: one line on the finding, one on the remedy."""

_LINES = r'''
API001|Endpoint may lack an authentication step|Put authentication middleware in front of the route
API002|GraphQL schema can be introspected|Switch introspection off outside development
API003|Route may lack a rate limit|Limit requests per caller
API004|Error detail is sent to the caller|Return a generic error and keep the detail in the log
API005|Request body size is not limited|Set a maximum body size on the parser
API006|Debug mode is switched on|Drive debug switches from the environment and keep them off in production
API007|Stack trace reaches the caller|Log the trace on the server only
API008|API key should be checked first|Check the key before any other work
API009|API keys should expire|Give keys an expiry date and a way to rotate them
API010|Object is fetched by an id the caller chose|Check that the caller owns the object
API011|Permissions are wider than needed|Grant the smallest set of rights
API012|Burst limits are worth setting|Set burst limits and return rate-limit headers
API013|One rate limit serves all callers|Use separate limits for anonymous and signed-in callers
API014|Check protection against floods|Place the service behind flood protection
API015|Response headers name the server software|Remove headers that name products or versions
API016|Header hardening is worth a check|Review the hardening middleware settings
AUTH001|JWT signing secret is written in the code|Load the secret from a vault or the environment
AUTH002|Session cookie lacks protective flags|Set httpOnly and secure on session cookies
AUTH003|Password is compared with an ordinary operator|Compare hashes in constant time
AUTH004|Access check is switched off or always true|Derive rights from the verified identity
AUTH005|Minimum password length is too small|Ask for at least twelve characters
AUTH006|Login route should be rate limited|Slow down repeated login attempts
AUTH007|Token is kept in browser storage|Keep session tokens in httpOnly cookies
BIZ001|Paid feature may be gated in the browser only|Check the plan on the server
BIZ002|Payment state should be confirmed by the server|Wait for the processor's signed callback
BIZ003|Refund could run twice|Make refunds idempotent
BIZ004|Trial logic can be abused|Bind trials to a verified account
BIZ005|Cancelled plans should lose access|Revoke access when a plan ends
BIZ006|Plan state can drift from the processor|Reconcile plan state with the processor
BIZ007|Quota may be enforced in the browser only|Enforce the quota on the server
BIZ008|Usage is taken from the client|Measure usage on the server
BIZ009|Quota reset should follow server time|Reset quotas by the server clock
CMD001|Shell command is built from request data|Call execFile with an argument list
CMD002|Process is spawned through a shell with request data|Drop the shell option and pass arguments separately
CMD003|Python shell call is built from joined strings|Use subprocess with a list
CMD004|Python subprocess runs through a shell|Set shell to false and pass a list
CMD005|PHP shell call takes request data|Avoid the shell or escape each argument
CMD006|Ruby shell call takes interpolated input|Pass arguments as a list
CMD007|Java process is started from joined strings|Use ProcessBuilder with separate arguments
CORS001|Every origin is allowed|List the trusted origins
CORS002|Credentials are allowed across origins|Combine credentials with a fixed list of origins
CORS003|Origin header is echoed back|Check the origin against a list
CORS004|All methods are allowed across origins|Allow only the methods in use
CORS005|Cross-origin headers are worth a review|Expose only the headers in use
CORS006|Preflight answers are cached for too long|Keep the preflight cache below a day
CSRF001|Form may lack an anti-forgery token|Add a token to each state-changing form
CSRF002|Anti-forgery protection is switched off|Switch the protection on
CSRF003|Cookie is sent on cross-site requests|Use SameSite Lax or Strict
CSRF004|State changes through a GET route|Use POST, PUT or DELETE
CSRF005|Anti-forgery tokens need checking|Verify the token on each state change
CSRF006|Anti-forgery token may be guessable|Take tokens from a secure random source
CSRF007|Anti-forgery tokens should expire|Rotate tokens with the session
CSRF008|A double-submit cookie may help|Compare a cookie with a request field
CSRF009|A custom request header may help|Ask for a header that only scripts can set
DB001|SQL is built by joining strings|Use bound parameters
DB002|Query object comes from the request|Check types and pick the allowed fields
DB003|Connection string holds a password|Load the password from a vault
DB004|Raw query may take input|Bind the values in raw queries
DB005|System command is built from input|Avoid the shell or pass a list
DB006|Query reads every column|Name the columns in use
DB007|Destructive SQL|Review the statement and keep a backup
DB008|Database account may hold too many rights|Use an account with the rights it needs
DB009|Backups should be tested|Restore a backup from time to time
DB010|Database access should be logged|Switch on audit logging
DB011|Default database account or password|Change default accounts and passwords
DB012|Database host is reachable locally or widely|Restrict the network that can reach the database
DB013|Query text is a literal|Prefer bound parameters throughout
DEP001|Dependency version is a range|Pin an exact version
DEP002|Dependencies need regular updates|Update on a schedule
DEP003|Patches should be applied quickly|Apply security patches within two days
DEP004|Dependencies should be scanned|Run a dependency scan each week
DEP005|Known weak packages need a plan|Replace or patch the affected packages
DEP006|Indirect dependencies need attention|Scan the whole dependency tree
DESER001|Python pickle loads bytes|Use JSON for data from outside
DESER002|Python marshal loads bytes|Use JSON for data from outside
DESER003|Python YAML is loaded without limits|Use safe_load
DESER004|Python YAML load names no safe loader|Use safe_load or pass SafeLoader
DESER005|Java object stream is read|Filter classes or use a data format
DESER006|Unsafe .NET formatter|Use a JSON or contract serializer
DESER007|PHP unserialize takes request data|Use json_decode
DESER008|Node evaluates request data|Parse the data instead of running it
DESER009|Ruby loads objects from input|Use safe_load or JSON
DOCKER001|Base image tag can move|Pin a version or a digest
DOCKER002|Image may run as root|Add a USER line
DOCKER003|Secret ends up in an image layer|Use build secrets or run-time variables
DOCKER004|ADD fetches a URL|Download and verify a checksum instead
DOCKER005|ADD copies a local path|Use COPY
DOCKER006|Packages are installed without limits|Skip recommended packages and clean the cache
DOCKER007|Downloaded script is piped into a shell|Download, verify, then run
DOCKER008|Health check is switched off|Define a health check
ENC001|Weak cipher or hash|Use SHA-256 or better, AES-GCM, or a password hash
ENC002|Key or nonce is written in the code|Take keys from a key service
ENC003|Plain HTTP address|Use HTTPS
ENC004|Certificate checks are switched off|Keep certificate checks on
ENC005|Random numbers are predictable|Use a secure random source
ENC006|ECB mode leaks structure|Use GCM
ENC007|Sensitive value is logged|Mask the value before logging
ENC008|Personal data should be encrypted|Encrypt personal fields at rest
ENC009|Transport security header needs a check|Set a max-age of a year and include subdomains
ENC010|Personal field is logged in clear|Mask personal fields in logs
ENC011|Backups should be encrypted|Encrypt backups and restrict access
ENC012|Personal records need export and deletion|Offer export and deletion on request
FILE001|File path comes from the request|Resolve the path and check it stays below a base folder
FILE002|Uploads need checks|Check type, size and content of uploads
FILE003|Temporary file may be readable by others|Create temporary files with private rights
FILE004|Symbolic links are followed|Do not follow links from outside the base folder
FILE005|File is writable by everyone|Use narrow file rights
FILE006|Path is joined with request data|Resolve the path and check its prefix
FILE007|Uploads may be served directly|Store uploads outside the web root
FILE008|Uploads are not scanned|Scan uploads for malware
FILE009|Storage bucket may be public|Block public access
FILE010|Public files should use signed links|Serve files through signed links
FILE011|Storage rules need a check|Limit access to owners
FILE012|Upload allows executable files|Refuse executable types
FILE013|Storage access should be logged|Switch on access logs
FILE014|File type is judged by its name|Check the leading bytes
FE001|Text is run as code|Avoid eval and string timers
FE002|Message is posted to every origin|Name the target origin
FE003|New tab keeps a handle on the opener|Add rel noopener noreferrer
FE004|Frame has no sandbox|Add a sandbox attribute
FE005|Remote script has no integrity value|Add an integrity attribute
FE006|Cookie is written by script|Set cookies on the server with httpOnly
FE007|Object prototype is touched|Refuse __proto__ and constructor keys
FE007a|Request data is merged into an object|Check keys before merging
FE007b|Request data is merged deeply|Check keys or use a fixed version
FE007c|Request data is spread into an object|Pick the allowed fields
FE008|Third-party script host|Add integrity values to third-party resources
FE009|Validation happens in the browser|Repeat the validation on the server
FE010|Window opens a chosen address|Check the address against a list
FE011|Sensitive value in browser storage|Keep sensitive values on the server
FE012|Page input reaches a page sink|Encode or sanitise the value
FE013|Redirect follows request data|Check the target against a list
INFRA001|Environments should be separate|Use separate databases and keys per environment
INFRA002|Debug mode may reach production|Set debug off in production settings
INFRA003|Log level is verbose|Lower the level in production
INFRA004|Stack traces may reach users|Switch off detailed errors in production
INFRA005|Secret may end up in an image|Pass secrets at run time
INFRA006|Build logs may show secrets|Mask secrets in build logs
INFRA007|Source maps may be published|Keep source maps private
INFRA008|Test data may reach production|Remove test data from production code
XSS001|HTML is assigned from a value|Use textContent or sanitise first
XSS002|Page is written by script|Use DOM methods
XSS003|HTML is joined with input|Encode the input
XSS004|React sets raw HTML|Sanitise the HTML first
XSS005|Template prints without escaping|Use the escaping form
XSS006|Request fields are used directly|Validate request fields
XSS007|Angular sanitising is bypassed|Avoid the bypass helpers
XSS008|Content security policy is worth setting|Set a strict policy
XSS009|Input length is not limited|Limit the length of input
XSS010|Input may reach an inline script|Encode values for script context
XSS011|Input is placed in a URL|Encode URL parts
XSS012|Content type is not checked|Check the content type of requests
XSS013|Use a validation library|Describe input with a schema
XSS014|Response echoes input|Encode values before sending
XSS015|HTML is assigned without a sanitiser|Sanitise before assigning
XSS016|Output needs encoding for its place|Use the encoder that fits the place
JWT001|Unsigned tokens are accepted|Name one signing algorithm
JWT002|Verification names no algorithms|Pass the list of allowed algorithms
JWT003|Token is decoded without a check|Verify before trusting the claims
JWT004|Python decode names no algorithms|Pass the algorithms argument
JWT005|Java parser names no algorithm|Require the algorithm on the parser
JWT006|Token expiry is ignored|Check the expiry with a small tolerance
JWT007|Issuer or audience is not checked|Check issuer and audience
KT-AUTH001|Web view runs scripts|Enable scripts only for trusted pages
KT-AUTH002|Web view exposes native code|Avoid script interfaces
KT-AUTH003|Broadcast names no permission|Require a permission
KT-AUTH004|Receiver may be exported|Register it as not exported
KT-AUTH005|Implicit intent may leak data|Name the target component
KT-AUTH006|Click handler can be overlaid|Filter touches when covered
KT-XSS001|Web view opens files|Switch file access off
KT-XSS002|Web view opens content URIs|Switch content access off
KT-XSS003|Web view mixes plain HTTP|Never allow mixed content
KT-XSS004|Web view accepts bad certificates|Cancel on certificate errors
KT-ENC001|Random numbers are predictable|Use SecureRandom
KT-ENC002|Preferences are stored in clear|Use encrypted preferences
KT-ENC003|Key is written in the code|Use the key store
KT-ENC004|Weak cipher|Use AES-GCM
KT-ENC005|Clear-text traffic is allowed|Allow TLS only
KT-ENC006|Certificates are not pinned|Pin the certificate
KT-FILE001|File is open to all apps|Use private mode
KT-FILE002|Shared storage is used|Use app storage
KT-DB001|Raw query in the data layer|Bind the values
KT-LOG001|Log line may hold sensitive data|Strip logs from release builds
KT-LOG002|Clipboard holds sensitive data|Avoid the clipboard for secrets
KT-CRED001|Key or password in Kotlin code|Load it from a secure store
K8S001|Container is privileged|Set privileged to false
K8S002|Pod uses the host network|Remove hostNetwork
K8S003|Pod shares host processes|Remove hostPID and hostIPC
K8S004|Container may run as root|Run as a non-root user
K8S005|Host folder is mounted|Use a volume of the cluster
K8S006|Container asks for more capabilities|Drop all and add what is needed
K8S007|Role allows everything|List verbs and resources
K8S008|Service is exposed widely|Restrict the source ranges
LDAP001|LDAP filter is joined with input|Escape filter values
LDAP002|Java LDAP filter is joined with input|Use the filter encoder
LDAP003|Python LDAP filter is joined with input|Use escape_filter_chars
LOG001|Login attempts should be logged|Log success and failure
LOG002|Refused access should be logged|Log each refusal
LOG003|Admin actions should be logged|Log privileged actions
LOG004|Changes of rights should be logged|Log changes of roles and keys
LOG005|Password may be logged|Keep passwords out of logs
LOG006|Key or secret may be logged|Keep secrets out of logs
LOG007|Logs should be stored safely|Encrypt stored logs
LOG008|Log access should be restricted|Limit who can read logs
LOG009|Exports should be logged|Log data exports and key changes
OAUTH001|Callback ignores the state value|Check state against the session
OAUTH002|Authorize address lacks state|Send a random state value
OAUTH003|Code exchange lacks PKCE|Send a code verifier
OAUTH004|Redirect target comes from the request|Compare it with the registered targets
OAUTH005|Implicit flow is outdated|Use the code flow with PKCE
OAUTH006|Scope is missing or too wide|Ask for the scopes in use
HDR001|Frame protection header may be missing|Send X-Frame-Options or frame-ancestors
HDR002|Content sniffing header may be missing|Send nosniff
HDR003|Referrer header may be missing|Send a referrer policy
HDR004|Feature policy may be missing|Send a permissions policy
HDR005|Sensitive response may be cached|Send no-store
SSRF001|fetch follows a chosen address|Check the host against a list
SSRF002|axios follows a chosen address|Check the host against a list
SSRF003|Node request follows a chosen address|Check the host against a list
SSRF004|Python request follows a chosen address|Check the host against a list
SSRF005|Python urlopen follows a chosen address|Check the host against a list
SSRF006|Java client follows a chosen address|Check the host against a list
SSRF007|PHP client follows a chosen address|Check the host against a list
SSRF008|Go client follows a chosen address|Check the host against a list
SSRF009|Webhook address is fetched|Check callback hosts against a list
SSTI001|Flask template comes from the request|Render fixed templates only
SSTI002|Jinja template comes from the request|Render fixed templates only
SSTI003|EJS template comes from the request|Render fixed templates only
SSTI004|Handlebars template comes from the request|Render fixed templates only
SSTI005|Pug template comes from the request|Render fixed templates only
SSTI006|ERB template comes from the request|Render fixed templates only
SSTI007|Java template comes from the request|Render fixed templates only
SSTI008|PHP template comes from the request|Render fixed templates only
TF001|Ingress is open to everyone|Name the source ranges
TF002|Bucket is public|Make the bucket private
TF003|Policy allows everything|Name actions and resources
TF004|Database is public|Keep the database private
TF005|Storage is not encrypted|Switch encryption on
TF006|Secret in infrastructure code|Read it from a secret store
TF007|Audit logging is off|Switch logging on
TF008|Role carries an admin policy|Attach a narrow policy
TF009|Listener speaks plain HTTP|Redirect to HTTPS
TF010|Key policy allows everything|Name principals and actions
XXE001|Java document parser is not hardened|Disallow document types
XXE002|Java SAX parser is not hardened|Disallow document types
XXE003|Java stream parser is not hardened|Switch external entities off
XXE004|Python lxml parser is not hardened|Switch entity resolution off
XXE005|Python standard XML parser|Use a hardened XML package
XXE006|.NET XML reader resolves entities|Set the resolver to null
XXE007|.NET reader parses document types|Prohibit document types
XXE008|PHP XML loader is not hardened|Disable the entity loader
XXE009|Node XML parser expands entities|Leave entity expansion off
CRED001|Password or secret is written in the text|Move it to a vault or the environment
CRED002|Cloud access key|Revoke the key and use roles
CRED003|Private key|Remove the key and issue a new one
CRED004|Code-host access token|Revoke the token
CRED005|Long random value in a string|Check whether it is a secret and move it
CRED006|Secret has a fallback value|Fail when the variable is missing
CRED007|Sensitive file is named|Keep the file out of version control
CRED008|Secrets should be rotated|Rotate secrets and review access
CRED009|History may hold secrets|Scan the commit history
TOKEN001|Anthropic API key|Revoke the token and load it at run time
TOKEN002|OpenAI API key|Revoke the token and load it at run time
TOKEN003|Slack token|Revoke the token and load it at run time
TOKEN004|Google API key or OAuth secret|Revoke the token and load it at run time
TOKEN005|Stripe live key|Revoke the token and load it at run time
TOKEN006|Stripe test key|Keep test keys out of the code
TOKEN007|Twilio key|Revoke the token and load it at run time
TOKEN008|SendGrid key|Revoke the token and load it at run time
TOKEN009|Mailgun key|Revoke the token and load it at run time
TOKEN010|npm token|Revoke the token and load it at run time
TOKEN011|Docker Hub token|Revoke the token and load it at run time
TOKEN012|Shopify token|Revoke the token and load it at run time
TOKEN013|Notion token|Revoke the token and load it at run time
TOKEN014|Linear key|Revoke the token and load it at run time
TOKEN015|Figma token|Revoke the token and load it at run time
TOKEN016|Databricks token|Revoke the token and load it at run time
TOKEN017|Hugging Face token|Revoke the token and load it at run time
TOKEN018|Discord bot token|Revoke the token and load it at run time
TOKEN019|Discord webhook|Recreate the webhook
TOKEN020|Bitbucket token|Revoke the token and load it at run time
TOKEN021|Atlassian token|Revoke the token and load it at run time
TOKEN022|DigitalOcean token|Revoke the token and load it at run time
TOKEN023|Sentry token|Revoke the token and load it at run time
TOKEN024|Postman key|Revoke the token and load it at run time
TOKEN025|Pulumi token|Revoke the token and load it at run time
TOKEN026|Square token|Revoke the token and load it at run time
TOKEN027|GitLab runner token|Revoke the token and load it at run time
TOKEN028|Address holds a user name and password|Remove the credentials from the address
'''

TEXTS: dict[str, tuple[str, str]] = {}
for _line in _LINES.strip().splitlines():
    _code, _message, _suggestion = _line.split("|")
    TEXTS[_code] = (_message, _suggestion)
